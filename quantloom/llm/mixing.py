"""Mixing sources to target weights by Efraimidis-Spirakis sampling, on DataFrame functions only.

Every source gets a target number of words.  Each document draws the key ``-ln(u) / w``, with u a
hash of its id and w its quality weight; a source's documents in order of their keys are a weighted
sample without replacement at every length.  Complete epochs come first: a target of e epochs and a
rest takes every document e times and then the first documents whose sizes add up to the rest; the
last of them is cut to fit.

Prefix sums run in two levels: keys are cut on a logarithmic scale into buckets, finer for larger
sources, so that no window holds more than a small share of a hot source.  Rows that agree in id, text and source
are one entry with a count, made before anything is dealt out by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import looked_up
from .storage import checkpointed, stored

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_BUCKET = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight in [0.05, 1] that falls with the share of symbols in the text."""
    clean = F.length(F.translate(text, "#*$%&|<>!", "")).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), clean * clean * clean * clean), F.lit(0.05))


def uniform(ident: Column, text_hash: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 of the id, or of the text where there is none; the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.concat(F.lit("text "), text_hash.cast("string")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, nth, source_size, n_docs, target) from rows (source, size, n), each of which stands for n documents of that size.

    Water-filling: in order of cap over weight, a source is capped if what is left for each unit of
    weight exceeds its cap; the level after the last capped source serves all others."""
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        by_source.withColumn("nth", nth)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("total", F.least(F.lit(share), F.lit(most)) * F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", left / free)
        .withColumn("common", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "nth", "level"))).over(whole))
        .withColumn("target", F.when(F.col("level") < F.col("ratio"), F.col("common.level") * F.col("weight")).otherwise(F.col("cap")))
        .select("source", "nth", "source_size", "n_docs", "target")
    )


def _identity(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    """A name of a row's id, text and source, nulls included."""
    cells = [x for c in (F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`")) for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))


def _groups(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(name, doc_id, text_hash, source, size, n, source_size, target, epochs, part) for each group of n rows of one name.

    part: the words that the fractional epoch takes of the group."""
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    text_hash = F.xxhash64(text)
    key = -F.log(uniform(ident, text_hash, seed)) / quality_weight(text)
    each = docs.select(_identity(docs, id_col, text_col, source_col).alias("name"), ident.alias("doc_id"), text_hash.alias("text_hash"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), key.alias("key"))
    drawn = checkpointed(each.groupBy("name", "doc_id", "text_hash", "source", "size", "key").agg(F.count("*").alias("n")))
    targets = checkpointed(source_targets(drawn, weights, share, most))
    fine = F.greatest(F.lit(16), F.ceil(F.col("n_docs") / ROWS_A_BUCKET))
    rows = drawn.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("name", "doc_id", "text_hash", F.col("d.source").alias("source"), "size", "n", "key", "nth", "source_size", "target", F.floor(F.log2("key") * fine).alias("bucket"))
    words = F.col("size") * F.col("n")
    earlier = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("nth", "bucket").agg(F.sum(words).alias("bucket_size")).withColumn("base", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    inside = Window.partitionBy("nth", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("base") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(words, rest - F.col("ahead"))).cast("long")
    found = rows.join(base, ["nth", "bucket"]).withColumn("ahead", ahead).withColumn("epochs", epochs)
    return found.select("name", "doc_id", "text_hash", "source", "size", "n", "source_size", "target", "epochs", part.alias("part"))


#: The words taken of the i-th row of a group: whole epochs, and what the rows before it leave of the group's part.
_TAKEN = "CAST(epochs * size + greatest(0, least(size, part - (i - 1) * size)) AS LONG)"


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) for each row.

    Sources in order of code point, null last, weigh ``weights``, repeating, and share ``share`` of
    all words; none takes more than ``most`` times its size.  Null and wordless texts have size 0 and
    are never taken.  A row without an id draws by its text.  Rows with one id draw one key and follow each
    other by size and text, so repeated rows each count; an empty table gives an empty result; other columns are ignored."""
    found = _groups(docs, weights, share, most, seed, id_col, text_col, source_col)
    each = found.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.expr(_TAKEN).alias("taken"))


def _places(rows: DataFrame) -> DataFrame:
    """(number, i): rows (name, number) counted from 1 within each name, in two levels, by number."""
    part = rows.withColumn("part", F.shiftright("number", 33))  # the partition the number was made in
    sizes = part.groupBy("name", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("name", "part").orderBy("number"))
    return part.withColumn("inside", inside).join(sizes.withColumn("before", before), ["name", "part"]).select("number", (F.col("before") + F.col("inside")).alias("i"))


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs as often as the mix takes them; the last of a source is cut to the words taken.

    All columns stay, whatever their names; a cut text has its first words joined by one space.  Rows without words are
    never taken; null ids and sources and repeated rows are taken as in mix, each for itself; an empty table
    gives an empty result.  docs are written once, with numbers by which repeated rows are told apart."""
    name = _identity(docs, id_col, text_col, source_col)
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"), F.monotonically_increasing_id().alias("number")))
    groups = checkpointed(_groups(docs, weights, share, most, seed, id_col, text_col, source_col).where("epochs * size * n + part > 0").select("name", "size", "n", "epochs", "part"))
    met = looked_up(rows, groups, "name", "size", "n", "epochs", "part").where("n IS NOT NULL")
    if groups.where("n > 1").limit(1).count():
        many = checkpointed(looked_up(rows.select("name", "number"), groups, "name", "n").where("n > 1").select("name", "number"))
        met = met.where("n = 1").withColumn("i", F.lit(1).cast("long")).unionByName(met.where("n > 1").join(_places(many), "number"))
    else:
        met = met.withColumn("i", F.lit(1).cast("long"))
    met = met.withColumn("taken", F.expr(_TAKEN)).where("taken > 0")
    copies = met.withColumn("nth", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size")).cast("int")
    text = F.col("row").getField(text_col).cast("string")
    cut = F.when(words < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), F.lit(1), words), " ")).otherwise(text)
    return copies.select(*[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
