"""How much the sources of a language differ in their words, by joint histograms of counts.

The divergence of two sources sums a function of two counts over all terms, and
most terms share their pair of counts with many others.  So each pair of
sources gets a histogram: how many terms occur a times here and b times there.
Cells with two counts above zero come from a join of the sources of a term; the
cells with a zero are implied by each source's own histogram and the number of
terms, and no row stands for a term that a source lacks.  The function is then
evaluated once for each cell and multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch
from tagloom.llm.words import Words, slices

MIN_DOCUMENTS = 10
TOP_TERMS = 10
#: Shares of a term are whole numbers of this part of all.
SCALE = 1_000_000_000

# a term is a run of letters A-Z, lower-cased, a-z and all characters above 0x7F, so of bytes above it
_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    to = np.cumsum(size)
    flat = data[np.repeat(start - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], to)).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice of texts: (lang, source, term, occurrences, documents), and a row with an empty term for each group."""
    for b in batches:
        names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        numbers = {name: k for k, name in enumerate(dict.fromkeys(names))}
        langs, sources = (pa.array([n[k] for n in numbers], pa.string()) for k in (0, 1))
        code = np.array([numbers[n] for n in names], np.int64)
        for at, to, texts in slices(b.column(2)):
            own = code[at:to]
            words = Words.mapped(_LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))
            unique, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            kinds = max(len(unique), 1)
            keys, n = np.unique(own[words.doc] * kinds + which, return_counts=True)
            in_doc = np.unique(words.doc * kinds + which)
            in_group, docs = np.unique(own[in_doc // kinds] * kinds + in_doc % kinds, return_counts=True)
            assert np.array_equal(keys, in_group)
            at_first = first[keys % kinds] if len(unique) else np.zeros(0, np.int64)
            terms = _strings(words.data, words.start[at_first], words.end[at_first])
            groups, rows = np.unique(own, return_counts=True)
            group = np.concatenate((keys // kinds, groups))
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(group)), sources.take(pa.array(group)), pa.concat_arrays([terms, pa.array([""] * len(groups), pa.string())]),
                    pa.array(np.concatenate((n, np.zeros(len(groups), np.int64)))), pa.array(np.concatenate((docs, rows))),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents of the group with it; an empty term stands for the group itself, with its documents.

    Null lang, source and text count as empty.  Slices of texts are counted in
    their task and task sums are merged, so no group meets in one place.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    sliced = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return sliced.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, size: str) -> str:
    """SQL of a term's share with additive smoothing; exact, since products are decimals."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * ({count} + 2)) div ({size} + 2 * terms)"


def _gap(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def _pairs(groups: DataFrame) -> DataFrame:
    """(lang, g, h, size_g, size_h, terms): each two sources of a language once; the answer has a row for each of them both ways."""
    side = lambda k: groups.select("lang", F.col("source").alias(k), F.col("size").alias(f"size_{k}"), *["terms"] * (k == "g"))
    return side("g").join(side("h"), "lang").where("g < h")


def joint_histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, size_g, size_h, terms, a, b, m): m terms occur a times in g and b times in h, zeros included.

    kept: (lang, term, source, n, size, terms), n above 0; groups: (lang,
    source, size, terms).
    """
    by = ["lang", "g", "h", "size_g", "size_h", "terms"]
    side = lambda k, n: kept.select("lang", "term", F.col("source").alias(k), F.col("size").alias(f"size_{k}"), F.col("n").alias(n), *["terms"] * (k == "g"))
    both = side("g", "a").join(side("h", "b"), ["lang", "term"]).where("g < h").groupBy(*by, "a", "b").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    # a term in both leaves the cells that the two sources' own histograms put it into
    cells = both.select(*by, F.inline(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))))
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    pairs = _pairs(groups)
    n = F.col("n")
    of_g = own.withColumnRenamed("source", "g").join(pairs, ["lang", "g"]).select(*by, F.inline(F.array(cell(n, zero, m), cell(zero, zero, -m))))
    of_h = own.withColumnRenamed("source", "h").join(pairs, ["lang", "h"]).select(*by, F.inline(F.array(cell(zero, n, m), cell(zero, zero, -m))))
    none = pairs.select(*by, zero.alias("a"), zero.alias("b"), F.col("terms").alias("m"))
    return cells.unionByName(of_g).unionByName(of_h).unionByName(none).groupBy(*by, "a", "b").agg(F.sum("m").alias("m")).where("m <> 0")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (lang, source, text; more columns are ignored).

    A language keeps the terms of at least ``min_documents`` of its rows.  Part
    ``pair``: each other source of the language with its divergence over all
    kept terms, all ranks; 0 where the language keeps none.  Part ``term``: the
    kept terms that a source has more of than its language, ``top_terms`` of
    them.  Values descend, ties go to the smaller item by code point.  Null
    columns count as empty, groups without terms take part, repeated rows count
    each; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(term_counts(docs), "counts")
    # a window holds the sources of one term
    of_term = Window.partitionBy("lang", "term")
    terms = counts.where("term <> ''").withColumn("in_docs", F.sum("docs").over(of_term)).where(F.col("in_docs") >= min_documents)
    kept = scratch.save(terms.select("lang", "term", "source", "n", F.sum("n").over(of_term).alias("total"), (F.col("source") == F.min("source").over(of_term)).alias("once")), "kept")
    per_lang = kept.groupBy("lang").agg(F.sum(F.col("once").cast("long")).alias("terms"), F.sum("n").alias("lang_size"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    present = counts.where("term = ''").select("lang", "source")
    zero = F.lit(0).cast("long")
    groups = present.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = scratch.save(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("size", "terms", "lang_size"))), "groups")
    sized = kept.join(groups, ["lang", "source"])

    histograms = joint_histograms(sized.select("lang", "term", "source", "n", "size", "terms"), groups.drop("lang_size"))
    valued = histograms.withColumn("p", F.expr(_share("a", "size_g"))).withColumn("q", F.expr(_share("b", "size_h"))).select("lang", "g", "h", F.expr(f"m * ({_gap('p', 'q')})").alias("value"))
    summed = valued.unionByName(_pairs(groups).select("lang", "g", "h", zero.alias("value"))).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item")), F.struct(F.col("h").alias("source"), F.col("g").alias("item")))
    pairs = summed.select("lang", "value", F.inline(ways)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    shares = sized.withColumn("p", F.expr(_share("n", "size"))).withColumn("q", F.expr(_share("total", "lang_size"))).where("p > q")
    best = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # tasks drop what is beyond the limit before rows of a group meet
    return pairs.withColumn("rank", place).unionByName(best.withColumn("rank", place).where(F.col("rank") <= top_terms))
