"""HTML view of pages, and links as editors see them.

Rendering is block by block, so it is one Arrow UDF over page texts; it is a
view for readers and on no other operator's path.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frontmatter import markdown_body
from .text import col

#: A link that is no image; a title after the target is no part of it.
EDITOR_LINK = r"(?<!!)\[([^\[\]]*)\]\(([^)\s]*)(?:\s+\"[^\"]*\")?\)"


def editor_links(pages: DataFrame) -> DataFrame:
    """(path, ordinal, text, href) as an editor finds them."""
    found = F.regexp_extract_all("content", F.lit(EDITOR_LINK), F.lit(0))
    rows = pages.select("path", F.posexplode(found).alias("ordinal", "m"))
    return rows.select("path", "ordinal", F.regexp_extract("m", EDITOR_LINK, 1).alias("text"), F.regexp_extract("m", EDITOR_LINK, 2).alias("href"))


_CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)")
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\(([^)\s]*)\)")
_LINK = re.compile(r"\[([^\[\]]*)\]\(([^)\s]*)(?:\s+&quot;.*?&quot;)?\)")
_BARE = re.compile(r"(?<![\"'>=])\bhttps?://[^\s<]+[^\s<.,;:!?)]")


def _inline(text: str) -> str:
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\0{len(kept) - 1}\0"

    text = _CODE.sub(lambda m: keep(f"<code>{html.escape(m[2].strip())}</code>"), text)
    text = html.escape(text)
    text = _IMAGE.sub(lambda m: keep(f'<img src="{m[2]}" alt="{m[1]}">'), text)
    text = _LINK.sub(lambda m: keep(f'<a href="{m[2]}">') + m[1] + "</a>", text)
    text = _BARE.sub(lambda m: keep(f'<a href="{m[0]}">{m[0]}</a>'), text)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<!\*)\*([^*\s][^*]*)\*", r"<em>\1</em>", text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


def heading_id(text: str) -> str:
    """Id of a heading in the view: underscores stay, dashes at the ends stay."""
    return re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", text.strip().lower()))


def render_page(body: str, first_line: int = 1) -> str:
    """HTML of a Markdown body: raw HTML is shown as text, blocks carry their source lines, diagrams are passed on."""
    out: list[str] = []
    lines = body.split("\n")
    i = 0
    while i < len(lines):
        line, mark = lines[i].rstrip("\r"), f' data-line="{first_line + i}"'
        fence = re.match(r"(`{3,}|~{3,})\s*([\w+-]*)", line)
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        item = re.match(r"\s*(?:([-*+])|(\d+)[.)])\s+(.*)", line)
        if fence:
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith(fence[1])), len(lines))
            code = html.escape("\n".join(lines[i + 1 : end]))
            out.append(f'<pre class="mermaid"{mark}>{code}</pre>' if fence[2] == "mermaid" else f'<pre{mark}><code class="language-{fence[2] or "text"}">{code}\n</code></pre>')
            i = end + 1
        elif heading:
            n = len(heading[1])
            out.append(f'<h{n} id="{html.escape(heading_id(heading[2]))}"{mark}>{_inline(heading[2])}</h{n}>')
            i += 1
        elif item:
            tag = "ul" if item[1] else "ol"
            rows = []
            while i < len(lines) and (m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", lines[i])):
                rows.append(f'<li data-line="{first_line + i}">{_inline(m[1])}</li>')
                i += 1
            out.append(f"<{tag}{mark}>" + "".join(rows) + f"</{tag}>")
        elif line.startswith(">"):
            quote = []
            while i < len(lines) and lines[i].startswith(">"):
                quote.append(lines[i].lstrip("> "))
                i += 1
            out.append(f"<blockquote{mark}><p>{_inline(' '.join(quote))}</p></blockquote>")
        elif not line.strip():
            i += 1
        else:
            start = i
            while i < len(lines) and lines[i].strip() and not (i > start and re.match(r"#{1,6}\s|`{3,}|~{3,}|>|\s*[-*+]\s", lines[i])):
                i += 1
            out.append(f"<p{mark}>" + "\n".join(_inline(x.rstrip("\r")) for x in lines[start:i]) + "</p>")
    return "\n".join(out)


def render_html(content: Column | str) -> Column:
    """HTML of a page without its frontmatter."""

    @F.arrow_udf("string")
    def render(body: pa.Array, skipped: pa.Array) -> pa.Array:
        return pa.array([None if b is None else render_page(b, 1 + n) for b, n in zip(body.to_pylist(), skipped.to_pylist(), strict=True)], pa.string())

    body = markdown_body(content)
    head = F.length(F.substr(col(content), F.lit(1), F.length(col(content)) - F.length(body)))
    skipped = F.length(F.regexp_replace(F.substr(col(content), F.lit(1), head), "[^\n]", ""))
    return render(body, F.coalesce(skipped, F.lit(0)))
