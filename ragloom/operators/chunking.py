"""Chunks: windows (K9), context headers (K10), fixed strategies (K11), section packing (K12), ids (K13), statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blocks_of, bound, part_of, running, settled, stretches, strip
from .textclean import HEADING

FIXED_SIZE, SECTION_SIZE, OVERLAP, SECTION_LEAST = 500, 900, 100, 150
HEADING_MOST, NOTE_OVER, TITLE_CUT = 60, 15, 40


def _last(part: Column, what: str) -> Column:
    """How far before the end of ``part`` the last ``what`` in it begins; 0 without one."""
    at = F.call_function("instr", F.reverse(part), F.lit(what[::-1]))
    return F.when(at > 0, at + len(what) - 1).otherwise(F.lit(0))


def windows(text: Column, size: int, overlap: int = OVERLAP) -> Column:
    """K9: overlapping pieces of at most ``size``, cut after the last sentence, else the last space, of their second half.

    A step is size / 2 + 1 - overlap at least, which bounds the number of pieces. Ends are folded first, as numbers;
    the pieces are cut out afterwards. A place is looked up in blocks of the text, so that a long one isn't read
    from its start again and again.
    """
    least, block = size // 2 + 1 - overlap, 4 * size
    if least < 1:
        raise ValueError("the overlap must be at most half of the size")

    def cut(x: Column) -> Column:
        n = x["n"]

        def part(start: Column, end: Column) -> Column:
            return part_of(x["blocks"], start, end, block)

        def step(a: Column, _: Column) -> Column:
            def ended(at: Column) -> Column:
                start, end = at["start"], at["end"]
                back = F.when(at["sentence"] > 0, at["sentence"]).otherwise(at["space"])
                stop = F.when((end < n) & (back > 0), end - back + 1).otherwise(end)
                return F.struct(start.alias("s"), stop.alias("e"))

            start = F.greatest(a["e"] - overlap, a["s"] + 1)
            end = F.least(start + size, n)
            halved = bound(part(start + size // 2, end), lambda p: F.struct(start.alias("start"), end.alias("end"), _last(p, ". ").alias("sentence"), _last(p, " ").alias("space")))
            return F.when(a["e"] >= n, a).otherwise(bound(halved, ended))

        # the first piece begins at 0: as if one had ended at the overlap
        first = F.struct(F.lit(-1).alias("s"), F.lit(overlap).alias("e"))
        ends = running(F.sequence(F.lit(1), F.ceil(n / least).cast("int") + 1), first, step, "struct<s:int,e:int>")
        # the fold stands still once the text's end is reached
        reached = bound(ends, lambda all_: F.slice(all_, 1, F.size(F.filter(all_, lambda c: c["e"] < n)) + 1))
        pieces = F.transform(reached, lambda c: strip(part(c["s"], c["e"])))
        return F.filter(pieces, lambda p: p != "")

    cut_up = bound(F.struct(F.length(text).alias("n"), blocks_of(text, block).alias("blocks")), cut)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(cut_up)


def context_header(title: Column, section: Column, label: Column, sectioned: Column) -> Column:
    """A line that names the document and the place."""
    page = F.concat(label, F.lit("쪽"))
    where = F.when(sectioned, section).when(section != "", F.concat(section, F.lit(" · "), page)).otherwise(page)
    return F.concat(F.lit("["), title, F.lit(" | "), where, F.lit("]\n"))


def fixed_chunks(units: DataFrame, with_context: bool, size: int = FIXED_SIZE) -> DataFrame:
    """Windows of each unit (doc_id, title, section, label, sectioned, text); no window spans units.

    Rows (doc_id, label, section, piece_no, text).
    """
    head = context_header(F.col("title"), F.col("section"), F.col("label"), F.col("sectioned")) if with_context else F.lit("")
    pieces = units.select("doc_id", "label", "section", head.alias("head"), settled(windows(F.col("text"), size)).alias("pieces"))
    cut = pieces.select("doc_id", "label", "section", "head", F.posexplode("pieces").alias("piece_no", "piece"))
    return cut.select("doc_id", "label", "section", "piece_no", F.concat("head", "piece").alias("text"))


def is_heading(paragraph: Column) -> Column:
    """A heading of at most 60 characters that isn't a numbered note."""
    note = F.regexp_extract(paragraph, "^(\\d+)\\)", 1)
    return paragraph.rlike(HEADING) & (F.length(paragraph) <= HEADING_MOST) & ((note == "") | (note.try_cast("int") <= NOTE_OVER))


def section_groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, group_no, section, body): paragraphs packed to about 900 characters, headings first.

    ``docs``: doc_id and paragraphs. Only the running size is sequential: a heading, or a paragraph that goes past
    the size, starts a group once the one before has 150 characters. A group's section is the last heading up to its end.
    """
    marked = docs.select("doc_id", settled(F.transform("paragraphs", lambda p, i: F.struct(p.alias("p"), F.when(is_heading(p), i).alias("h"), F.length(p).alias("n")))).alias("paras"))

    def step(a: Column, x: Column) -> Column:
        new = (a["size"] >= SECTION_LEAST) & (x["h"].isNotNull() | (a["size"] + x["n"] > SECTION_SIZE))
        return F.struct(F.when(new, x["n"]).otherwise(a["size"] + x["n"]).alias("size"), (a["no"] + F.when(new, 1).otherwise(0)).alias("no"), F.coalesce(x["h"], a["head"]).alias("head"))

    first = F.struct(F.lit(0).alias("size"), F.lit(0).alias("no"), F.lit(None).alias("head"))
    grouped = marked.withColumn("states", settled(running(F.col("paras"), first, step, "struct<size:int,no:int,head:int>")))
    begins = F.filter(F.transform("states", lambda x, i: F.when((i == 0) | (x["no"] > F.get("states", i - 1)["no"]), i)), lambda i: i.isNotNull())
    grouped = grouped.withColumn("begins", settled(begins))

    def group(k: Column, at: Column, end: Column) -> Column:
        head = F.get("paras", F.get("states", end - 1)["head"])["p"]
        section = F.coalesce(F.substring(F.regexp_replace(head, "^#+\\s*", ""), 1, TITLE_CUT), F.lit(""))
        body = strip(F.array_join(F.transform(F.slice("paras", at + 1, end - at), lambda x: x["p"]), "\n"))
        return F.struct(k.alias("group_no"), section.alias("section"), body.alias("body"))

    groups = grouped.select("doc_id", settled(F.filter(stretches(F.col("paras"), F.col("begins"), group), lambda x: x["body"] != "")).alias("groups"))
    return groups.select("doc_id", F.explode("groups").alias("x")).select("doc_id", "x.*")


def section_chunks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, group_no, section, piece_no, text)."""
    groups = section_groups(docs)
    pieces = groups.select("doc_id", "group_no", "section", settled(windows(F.col("body"), SECTION_SIZE)).alias("pieces"))
    return pieces.select("doc_id", "group_no", "section", F.posexplode("pieces").alias("piece_no", "text"))


def chunk_ids(chunks: DataFrame, *order: str) -> DataFrame:
    """Adds chunk_id, doc#0001 and on, in the given order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return chunks.withColumn("chunk_id", F.format_string("%s#%04d", F.col("doc_id").cast("string"), n))


def length_stats(chunks: DataFrame) -> DataFrame:
    """Length statistics for each strategy; means round half to even."""
    n = F.length("text")
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"), F.bround(F.avg(n), 1).alias("mean"), F.median(n).alias("median"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.sum(n).alias("total"))
