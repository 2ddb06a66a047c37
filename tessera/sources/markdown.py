"""Markdown sections: one item for each heading, down to two lines above the next."""

from __future__ import annotations

import re

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
OTHER_BLOCK = re.compile(r" {0,3}(?:>|[-*+][ \t]|\d{1,9}[.)][ \t]|<[A-Za-z/!?]|(?:[-*_][ \t]*){3,}$|\|)|\t| {4}")


def headings(lines: list[str]) -> list[tuple[int, str, int]]:
    """(level, title, line from 1) of the headings outside fenced and indented code."""
    out, fence, text_from = [], "", None
    for i, line in enumerate(lines):
        m = FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = ""
            continue
        if m and not (m[1][0] == "`" and "`" in line[m.end() :]):
            fence, text_from = m[1], None
        elif h := ATX.match(line):
            out.append((len(h[1]), (h[2] or "").strip() if not re.fullmatch(r"#+", h[2] or "") else "", i + 1))
            text_from = None
        elif text_from is not None and (s := SETEXT.match(line)):
            title = " ".join(x.strip() for x in lines[text_from:i])
            out.append((1 if s[1][0] == "=" else 2, title, text_from + 1))
            text_from = None
        elif not line.strip() or text_from is None and OTHER_BLOCK.match(line):
            text_from = None
        elif text_from is None:
            text_from = i
    return out


def parse(path: str, content: str) -> tuple[list[dict], list[dict]]:
    """Items (and no symbols) of one file; text before the first heading is in none. A heading without a title is an error."""
    lines = content.splitlines()
    found = headings(lines)
    items: list[dict] = []
    above: list[tuple[int, str]] = []
    for (level, title, top), after in zip(found, [*found[1:], None]):
        if not title:
            raise ValueError(f"heading without a title in line {top}")
        above = [x for x in above if x[0] < level] + [(level, title)]
        where = " > ".join(t for _, t in above)
        low = len(lines) if after is None else after[2] - 2
        while low > top and not lines[low - 1].strip():
            low -= 1
        low = max(top, low)
        items.append(
            {
                "id": f"doc:{path}:{where}", "asset_type": "doc", "title": title, "content": "\n".join(lines[top - 1 : low]).strip(), "summary": f"文档章节 {where}。",
                "metadata": {"heading_path": where, "heading_level": str(level)}, "source_type": "doc", "path": path, "start_line": top, "end_line": low, "heading_path": where,
            }
        )
    return items, []
