"""Cleaned Markdown to typed tables: sections, equations, tables, figures, additional information.

parse() works on one text; documents() runs it over a corpus, one row per document with arrays,
and exploded() makes a table of each array, keyed by doc_id and ord.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import listed
from .clean import BODY_STARTS, FRONT_MATTER, NUMBER, body_start  # noqa: F401

# Titles of what follows the main text.
ADDITIONAL = frozenset({
    "declaration of competing interest", "declaration of competing interests", "competing interest", "competing interests", "conflict of interest",
    "conflicts of interest", "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments", "data availability",
    "availability of data and materials", "author contributions", "credit authorship contribution statement", "contribution statement",
    "supplementary materials", "supplementary material", "appendix", "references",
})
# The forms of tables and figures after cleaning, and of cells that are numbers.
TABLE = re.compile(rf"(^#\s*Table\s*\.?\s*({NUMBER}).*?)\s*\n(<table>.*?</table>)", re.I | re.M | re.S)
FIGURE = re.compile(rf"(?:^!\[.*?\]\((.*?)\)\s*\n)?(^#\s*(?:Fig\.?|Figure)\s+({NUMBER}).*?$)", re.I | re.M)
NUMERIC = re.compile(r"[-–—]|\d+(?:\.\d+)?(?:±\d+(?:\.\d+)?)?%?")

#: Columns that a cell may span, as in HTML; a wider span counts as so many.
WIDEST = 1000

HIERARCHY = "array<struct<section_id:string,section_number:string,section_title:string,section_title_full:string>>"
GRID = "array<array<string>>"
SCHEMA = (
    "metadata_block string, strategy string, "
    f"sections array<struct<ord:int,section_id:string,section_number:string,section_title:string,section_title_full:string,level:int,parent_section_id:string,hierarchy:{HIERARCHY},content:string,equation_refs:array<string>>>, "
    "equations array<struct<ord:int,equation_id:string,equation_number:string,equation_label:string,latex:string>>, "
    f"tables array<struct<ord:int,table_id:string,table_number:string,caption:string,raw_html:string,data:struct<columns:array<string>,rows:{GRID},grid:{GRID},header_rows:{GRID},data_start_row:int>>>, "
    "figures array<struct<ord:int,figure_id:string,figure_number:string,caption:string,image_path:string,image_url:string>>, "
    "additional array<struct<ord:int,additional_info_title:string,content:string>>"
)


class _Cells(HTMLParser):
    """Rows of (text, is th, rowspan, colspan) of the first table; a nested table's text belongs to its cell."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif tag == "tr" and self.depth == 1:
            self.cell = None
            self.rows.append([])
        elif tag in ("td", "th") and self.depth == 1 and self.rows:
            self.cell = [[], tag == "th", *(self._span(dict(attrs).get(a)) for a in ("rowspan", "colspan"))]
            self.rows[-1].append(self.cell)

    @staticmethod
    def _span(said: str | None) -> int:
        said = (said or "").strip()
        return max(1, int(said[:9])) if said.isascii() and said.isdigit() else 1

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th", "tr") and self.depth == 1:
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell[0].append(data.strip())


def table_grid(html: str) -> tuple[list[list[str]], list[list[bool]]]:
    """Texts and th flags of a table, spans filled in and rows padded to the widest."""
    parser = _Cells()
    parser.feed(html)
    filled: dict[tuple[int, int], tuple[str, bool]] = {}
    height = len(parser.rows)
    for r, row in enumerate(parser.rows):
        c = 0
        for parts, head, down, across in row:
            across = min(across, WIDEST)
            while (r, c) in filled:
                c += 1
            for y in range(r, min(r + down, height)):
                for x in range(c, c + across):
                    filled.setdefault((y, x), (" ".join(parts), head))
            c += across
    width = 1 + max((x for _, x in filled), default=-1)
    cells = [[filled.get((y, x), ("", False)) for x in range(width)] for y in range(height)]
    return [[t for t, _ in row] for row in cells], [[h for _, h in row] for row in cells]


def header_rows(grid: list[list[str]], heads: list[list[bool]]) -> int:
    """How many of the first four rows are headers; of several rows one at least."""
    n = 0
    for i, (row, head) in enumerate(zip(grid[:4], heads[:4], strict=True)):
        texts = [t.strip() for t in row if t.strip()]
        if texts and sum(head) < 0.5 * len(head):
            words = sum(bool(NUMERIC.fullmatch(t)) for t in texts) < 0.5 * len(texts)
            repeats = len(set(texts)) < len(texts)
            if not ((repeats or words) if i == 0 else (n and repeats and words)):
                break
        n += 1
    return n or int(len(grid) > 1)


def column_names(rows: list[list[str]], width: int) -> list[str]:
    """Header rows joined downwards, without blanks and immediate repeats."""
    out = []
    for c in range(width):
        parts = [x for r in rows if c < len(r) and (x := r[c].strip())]
        parts = [x for k, x in enumerate(parts) if not k or parts[k - 1] != x]
        out.append("_".join(parts) or f"col_{c + 1}")
    return out


def table_data(html: str) -> dict:
    """Columns, rows, grid and header rows of a table; one that can't be read is empty, with data_start_row -1."""
    try:
        grid, heads = table_grid(html)
    except (AssertionError, RecursionError, ValueError):  # what HTMLParser raises on broken markup
        return {"columns": [], "rows": [], "grid": [], "header_rows": [], "data_start_row": -1}
    n = header_rows(grid, heads) if grid else 0
    return {"columns": column_names(grid[:n], len(grid[0])) if grid else [], "rows": grid[n:], "grid": grid, "header_rows": grid[:n], "data_start_row": n}


def _cut(md: str, matches: list[re.Match]) -> str:
    for m in reversed(matches):
        md = f"{md[: m.start()]}\n{md[m.end() :]}"
    return re.sub(r"\n{3,}", "\n\n", md).strip()


def extract_equations(md: str) -> tuple[str, list[dict]]:
    found: list[dict] = []

    def mark(m: re.Match) -> str:
        body, n = m[1].strip(), len(found) + 1
        tag = re.search(r"\\tag\{([^}]+)\}", body)
        number = (tag[1].strip() if tag else "") or str(n)
        found.append({"ord": n, "equation_id": f"eq_{n}", "equation_number": number, "equation_label": f"Equation {number}", "latex": body})
        return f"[EQUATION:eq_{n}]"

    return re.sub(r"\$\$(.*?)\$\$", mark, md, flags=re.S), found


def equations(docs: DataFrame, text: str = "text") -> DataFrame:
    """Display equations of any texts by column functions alone: doc_id, ord, equation_id, latex."""
    blank = " \t\n\x0b\x0c\r"
    found = docs.where(F.col(text).contains("$$")).select("doc_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)\$\$(.*?)\$\$"), F.lit(1))).alias("at", "body"))
    return found.select("doc_id", (F.col("at") + 1).alias("ord"), F.concat(F.lit("eq_"), F.col("at") + 1).alias("equation_id"), F.btrim("body", F.lit(blank)).alias("latex"))


def extract_tables(md: str) -> tuple[str, list[dict]]:
    matches = list(TABLE.finditer(md))
    rows = [{"ord": k, "table_id": f"table_{k}", "table_number": f"Table {m[2]}", "caption": re.sub(r"^#\s*", "", m[1].strip()), "raw_html": m[3].strip(), "data": table_data(m[3])} for k, m in enumerate(matches, 1)]
    return _cut(md, matches), rows


def extract_figures(md: str) -> tuple[str, list[dict]]:
    matches = list(FIGURE.finditer(md))
    rows = []
    for k, m in enumerate(matches, 1):
        path = (m[1] or "").strip()
        rows.append({"ord": k, "figure_id": f"fig_{k}", "figure_number": f"Fig. {m[3]}", "caption": re.sub(r"^#\s*", "", m[2].strip()), "image_path": path, "image_url": path})
    return _cut(md, matches), rows


def split_additional(md: str) -> tuple[str, list[dict]]:
    """The main text, and titled blocks from the first heading of additional information on."""
    at = next((m.start() for m in re.finditer(r"^##\s+(.*)$", md, re.M) if m[1].strip().lower() in ADDITIONAL), None)
    if at is None:
        return md.strip(), []
    rows = []
    for block in re.split(r"\n(?=##\s+)", md[at:].strip()):
        title, *content = block.strip().splitlines()
        rows.append({"ord": len(rows) + 1, "additional_info_title": re.sub(r"^##\s*", "", title).strip(), "content": "\n".join(content).strip()})
    return md[:at].strip(), rows


def extract_sections(md: str) -> list[dict]:
    """Sections in order; a level's number restarts below each lower level, and a parent is found by place in the stack."""
    out: list[dict] = []
    stack: list[dict] = []
    counts, held = [0] * 7, []

    def close() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body and stack:
            stack[-1]["content"], stack[-1]["equation_refs"] = body, re.findall(r"\[EQUATION:(eq_\d+)\]", body)

    for line in md.splitlines():
        m = re.match(r"(#{2,6})\s*(.*)$", line)
        if not m:
            held.append(line)
            continue
        close()
        level, title = len(m[1]) - 1, m[2].strip()
        counts[level] += 1
        counts[level + 1 :] = [0] * (6 - level)
        number = ".".join(str(n) for n in counts[1 : level + 1] if n)
        del stack[level - 1 :]
        own = {"section_id": f"sec_{number.replace('.', '_')}", "section_number": number, "section_title": title, "section_title_full": f"{number} {title}".strip()}
        chain = [{k: s[k] for k in own} for s in stack] + [dict(own)]
        out.append(own | {"ord": len(out) + 1, "level": level, "parent_section_id": stack[-1]["section_id"] if stack else None, "hierarchy": chain, "content": "", "equation_refs": []})
        stack.append(out[-1])
    close()
    return out


def parse(md: str | None) -> dict:
    md = (md or "").replace("\r\n", "\n").replace("\r", "\n")
    at, strategy = body_start(md, compact=False, front=frozenset(FRONT_MATTER), last=ADDITIONAL)
    head, main = (md.strip(), "") if at is None else (md[:at].strip(), md[at:].strip())
    main, equations = extract_equations(main)
    main, tables = extract_tables(main)
    main, figures = extract_figures(main)
    main, additional = split_additional(main)
    return {"metadata_block": head, "strategy": strategy, "sections": extract_sections(main), "equations": equations, "tables": tables, "figures": figures, "additional": additional}


def documents(docs: DataFrame, text: str = "md_text") -> DataFrame:
    """One row per document: doc_id, source_file and the parts.

    The parse is declared nondeterministic, so that the optimizer neither repeats it nor infers filters of exploded arrays from it.
    """
    return docs.select("doc_id", "source_file", listed(lambda md: [parse(x) for x in md], SCHEMA)(text).alias("p")).select("doc_id", "source_file", "p.*")


def exploded(parsed: DataFrame, part: str) -> DataFrame:
    return parsed.select("doc_id", "source_file", F.explode(part).alias("x")).select("doc_id", "source_file", "x.*")


def equations_in_context(parsed: DataFrame) -> DataFrame:
    """Equations with section fields and hierarchy of the last section that lists them."""
    sections = exploded(parsed, "sections").select("doc_id", "ord", "section_id", "section_number", "section_title", "section_title_full", "hierarchy", F.explode("equation_refs").alias("equation_id"))
    last = sections.groupBy("doc_id", "equation_id").agg(F.max_by(F.struct("section_id", "section_number", "section_title", "section_title_full", "hierarchy"), "ord").alias("s"))
    return exploded(parsed, "equations").join(last, ["doc_id", "equation_id"], "left").select("doc_id", "source_file", "ord", "equation_id", "equation_number", "equation_label", "latex", "s.*")


def processing_info(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", "strategy", *[F.size(p).alias(f"n_{p}") for p in ("sections", "equations", "tables", "figures", "additional")])


def references(parsed: DataFrame) -> DataFrame:
    """doc_id, number and content of the list in the block titled references: numbered items with their continuation lines, else one per line."""
    block = parsed.select("doc_id", F.filter("additional", lambda a: F.lower(F.trim(a["additional_info_title"])) == "references").alias("r")).where(F.size("r") > 0)
    lines = block.select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.get("r", F.lit(0))["content"], "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")).alias("pos", "line"))
    form = r"^(?:\[(\d+)\]\s*|(\d+)\.\s*|(\d+)\s+)(.*)$"
    number = F.concat(*[F.regexp_extract("line", form, k) for k in (1, 2, 3)])
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("number", number).withColumn("item", F.sum((F.col("number") != "").cast("int")).over(w)).withColumn("any", F.max((F.col("number") != "").cast("int")).over(Window.partitionBy("doc_id")))
    body = F.when(F.col("number") != "", F.trim(F.regexp_extract("line", form, 4))).otherwise(F.col("line"))
    items = marked.where("any = 1 and item > 0").groupBy("doc_id", "item").agg(F.max(F.when(F.col("number") != "", F.col("number"))).alias("number"), F.array_sort(F.collect_list(F.struct("pos", body.alias("text")))).alias("parts"))
    numbered = items.select("doc_id", F.col("item").cast("int").alias("ord"), "number", F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " ").alias("content")).where("content <> ''")
    plain = marked.where("any = 0").select("doc_id", (F.col("pos") + 1).alias("ord"), (F.col("pos") + 1).cast("string").alias("number"), F.col("line").alias("content"))
    return numbered.union(plain).withColumn("node_id", F.concat(F.lit("ref_"), "number"))
