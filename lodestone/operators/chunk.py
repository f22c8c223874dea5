"""Chunkers: one text to many titled chunks.

Format detection sends a text with a fence, ``---`` or nothing but one heading line to the markdown chunker and all
others to the plain one, which tries blank-line sections, then a single chunk, then overlapping windows of lines.
Both are array expressions in one projection: nothing is shuffled, and each line is visited once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import js_trim, let, lines

CHUNKS = "array<struct<title:string,content:string,has_code:boolean>>"
_ANY = "[^\\n\\r\\u2028\\u2029]"
HEADING = f"(?U)\\A(#{{1,4}})\\s+({_ANY}+)\\z"
SEPARATOR = r"(?U)\A[-_*]{3,}\s*\z"
FENCE = "```"


def is_markdown(text: Column) -> Column:
    """Whether the markdown chunker takes the text; the heading test looks at the text as a whole."""
    return text.rlike(HEADING) | text.contains(FENCE) | text.contains("---")


def _chunk(title: Column, content: Column, code: Column) -> Column:
    return F.struct(title.alias("title"), content.alias("content"), code.alias("has_code"))


def plain_chunks(text: Column, per_chunk: int = 20, overlap: int = 2, most_sections: int = 200, section_chars: int = 5120) -> Column:
    """Chunks of a plain text."""
    step = max(per_chunk - overlap, 1)

    def sectioned(parts: Column) -> Column:
        trimmed = F.filter(F.transform(parts, js_trim), lambda s: s != "")
        return F.transform(trimmed, lambda s: _chunk(F.substring(F.substring_index(s, "\n", 1), 1, 80), s, s.contains(FENCE)))

    def windows(ls: Column) -> Column:
        def window(i: Column) -> Column:
            part = F.slice(ls, i + 1, F.lit(per_chunk))
            first = F.substring(js_trim(F.get(part, F.lit(0))), 1, 80)
            numbered = F.concat(F.lit("Lines "), (i + 1).cast("string"), F.lit("-"), (i + F.size(part)).cast("string"))
            return _chunk(F.when(first != "", first).otherwise(numbered), js_trim(F.array_join(part, "\n")), F.lit(False))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(ls) - 1, F.lit(step)), window), lambda c: c["content"] != "")

    def unsectioned(ls: Column) -> Column:
        whole = F.array(_chunk(F.lit("Output"), js_trim(F.array_join(ls, "\n")), F.lit(False)))
        return F.when(F.size(ls) <= per_chunk, whole).otherwise(windows(ls))

    def choose(parts: Column) -> Column:
        usable = F.size(parts).between(3, most_sections) & F.forall(parts, lambda s: F.char_length(s) < section_chars)
        return F.when(usable, sectioned(parts)).otherwise(let(lines(text), unsectioned))

    return let(F.split(text, r"(?U)\n\s*\n", -1), choose)


def markdown_chunks(text: Column) -> Column:
    """Chunks of a markdown text, titled by the path of headings.

    A heading of level L cuts the path to L - 1 entries, by its depth and not by the levels in it. The fold over the
    lines keeps only where sections begin and end; their text is sliced out afterwards.
    """
    state = "struct<fence:boolean,code:boolean,start:int,path:array<string>,spans:array<struct<start:int,end:int,path:array<string>,code:boolean>>>"
    zero = F.from_json(F.lit('{"fence":false,"code":false,"start":0,"path":[],"spans":[]}'), state)

    def closed(s: Column, end: Column) -> Column:
        return F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["path"].alias("path"), s["code"].alias("code"))))

    def make(fence: Column, code: Column, start: Column, path: Column, spans: Column) -> Column:
        return F.struct(fence.alias("fence"), code.alias("code"), start.cast("int").alias("start"), path.alias("path"), spans.alias("spans")).cast(state)

    def step(s: Column, x: Column) -> Column:
        line, i = x["line"], x["i"]
        level = F.char_length(F.regexp_extract(line, HEADING, 1))
        path = F.concat(F.slice(s["path"], F.lit(1), F.least(F.size(s["path"]), level - 1)), F.array(js_trim(F.regexp_extract(line, HEADING, 2))))
        return (
            F.when(line.startswith(FENCE), make(~s["fence"], F.lit(True), s["start"], s["path"], s["spans"]))
            .when(s["fence"], s)
            .when(line.rlike(SEPARATOR), make(s["fence"], F.lit(False), i + 1, s["path"], closed(s, i)))
            .when(line.rlike(HEADING), make(s["fence"], F.lit(False), i, path, closed(s, i)))
            .otherwise(s)
        )

    def sections(ls: Column) -> Column:
        numbered = F.transform(ls, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
        spans = F.aggregate(numbered, zero, step, lambda s: closed(s, F.size(ls)))

        def cut(p: Column) -> Column:
            content = js_trim(F.array_join(F.slice(ls, p["start"] + 1, F.greatest(p["end"] - p["start"], F.lit(0))), "\n"))
            return let(content, lambda c: _chunk(F.when(F.size(p["path"]) > 0, F.array_join(p["path"], " > ")).otherwise(F.substring(c, 1, 80)), c, p["code"]))

        return F.filter(F.transform(spans, cut), lambda c: c["content"] != "")

    return let(lines(text), sections)


def chunks_of(text: Column) -> Column:
    """Chunks of a text of either format."""
    return F.when(is_markdown(text), markdown_chunks(text)).otherwise(plain_chunks(text))


def chunk(docs: DataFrame, label: str = "source", text: str = "text") -> DataFrame:
    """source_id, label, chunk_ord, title, content, content_type for each chunk of ``docs`` (doc_id, label, text).

    A null text has no chunks; an empty one has one, empty.
    """
    found = docs.select(F.col("doc_id").alias("source_id"), F.col(label).alias("label"), F.posexplode(chunks_of(F.col(text))).alias("chunk_ord", "c"))
    return found.select("source_id", "label", "chunk_ord", "c.title", "c.content", F.when(F.col("c.has_code"), "code").otherwise("text").alias("content_type"))


def index_summary(chunks: DataFrame) -> DataFrame:
    """Per source: total_chunks and code_chunks."""
    return chunks.groupBy("source_id", "label").agg(F.count(F.lit(1)).alias("total_chunks"), F.sum((F.col("content_type") == "code").cast("long")).alias("code_chunks"))
