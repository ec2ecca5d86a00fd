"""Substring dedup over sliding sentence spans.

A text is cut into sentences without losing a character. Every window of ``window`` (three) consecutive
sentences is hashed (128 bits), whatever its length: any longer repeated run is a union of such windows, so one
row per sentence finds runs of every length. A passage of fewer than ``window`` sentences has no window inside
it; therefore shorter runs are hashed beside the windows where they are long: two consecutive sentences of together
``pair_words`` words or more, and one sentence of ``alone_words`` or more. A piece without any word (blank lines, stray marks) is no
sentence of its own; it goes with the covered sentences around it.

Runs meet by hash over the whole table; the first occurrence in the order (id with nulls last, text key,
place) stays, and every sentence that another occurrence covers goes. That order is global, so some copy of
each removed sentence always remains. Runs are compared lower-cased (A-Z) and with blanks collapsed. A character
of a script without blanks counts as a word.

The run table is written once to the shared folder. Counting by hash combines on the map side; only runs that
repeat go on, by plain equi-joins whose left side Spark may split when a passage is very common.

Defined cases: null or empty text has no sentences and stays as it is; a text of fewer than ``window`` sentences has only the
long shorter runs; very long texts are hashed whole, one row a sentence; rows that share id and text are one
document, whose rows get equal results; equal runs of one text count like those of two, the earlier stays; null
ids come last; an empty table gives an empty result; all other columns pass through unchanged, and where the input has a column of
a name that is added here, the added one gets leading underscores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import free_names, map_arrow, text_key
from loomspan.storage import materialize

WINDOW = 3
PAIR_WORDS = 20
ALONE_WORDS = 50

_SENTENCE = re.compile(r"[^.!?\n。！？]*[.!?\n。！？]+\s*|[^.!?\n。！？]+")
_WORD_LIKE = re.compile(r"\w")
#: Kana, Han and Thai, Lao, Khmer, Burmese: written without blanks.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿\U00020000-\U0003ffff]")


def sentences(text: str | None) -> list[str]:
    """Consecutive pieces of ``text``; joined they are the text again."""
    return _SENTENCE.findall(text) if text else []


def _words(piece: str, plain: bytes) -> int:
    blanks = plain.count(b" ") + 1
    return blanks if piece.isascii() else blanks + len(_UNSPACED.findall(piece))


def spans(pieces: list[str], window: int = WINDOW, pair_words: int = PAIR_WORDS, alone_words: int = ALONE_WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Starts and stops (in ``pieces``) and digests of the hashed runs."""
    at = [i for i, p in enumerate(pieces) if _WORD_LIKE.search(p)]
    n = len(at)
    plain = [b" ".join(pieces[i].encode().lower().split()) for i in at]
    place = np.array(at, np.int64)
    counts = np.fromiter((_words(pieces[i], p) for i, p in zip(at, plain)), np.int64, n)
    first = np.arange(n)
    runs = [(first[: max(n - window + 1, 0)], window)]
    if window > 2 and n > 1:
        runs.append((np.flatnonzero(counts[:-1] + counts[1:] >= pair_words), 2))
    runs.append((np.flatnonzero(counts >= alone_words), 1))
    digest = xxhash.xxh3_128_digest
    starts = np.concatenate([a for a, _ in runs])
    lengths = np.concatenate([np.full(len(a), k) for a, k in runs])
    found = [digest(b" ".join(plain[a : a + k])) for own, k in runs for a in own.tolist()]
    return place[starts], place[starts + lengths - 1] + 1, found


def span_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **runs: int) -> DataFrame:
    """``h1, h2, doc_id, text_key, start, stop``: one row per hashed run."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, stops, digests = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            a, b, d = spans(sentences(text), **runs)
            rows.append(np.full(len(d), i))
            starts.append(a)
            stops.append(b)
            digests.extend(d)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(np.concatenate(rows))
        return pa.record_batch(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), batch.column(2).take(at), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(stops).astype(np.int32))],
            ["h1", "h2", "doc_id", "text_key", "start", "stop"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    return map_arrow(narrow, run, "h1 long, h2 long, doc_id long, text_key long, start int, stop int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **runs: int) -> DataFrame:
    """``doc_id, text_key, start, stop`` of every occurrence of a repeated run that is not its first.

    ``runs``: ``window``, ``pair_words``, ``alone_words``.
    """
    found = materialize(span_table(docs, id_col, text_col, **runs))
    # each side of a join is written before: it then has a plain exchange on either side and a hot run can be split
    twice = materialize(found.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    again = materialize(found.join(twice, ["h1", "h2"], "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "start")
    first = materialize(again.groupBy("h1", "h2").agg(F.min(place).alias("first")))
    return again.join(first, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "text_key", "start", "stop")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **runs: int) -> DataFrame:
    """``docs`` with the covered sentences cut from the text column, and three new columns:
    ``n_sentences``, ``n_removed`` (sentences) and ``words_removed``."""
    cuts = repeated_spans(docs, id_col, text_col, **runs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))
    cut_id, cut_key, own_cuts, done_col = free_names(docs, "cut_id", "cut_key", "cuts", "done")
    added = free_names(docs, "n_sentences", "n_removed", "words_removed")
    cuts = cuts.select(F.col("doc_id").alias(cut_id), F.col("text_key").alias(cut_key), F.col("cuts").alias(own_cuts))
    met = F.col(id_col).cast("long").eqNullSafe(F.col(cut_id)) & (text_key(F.col(text_col)) == F.col(cut_key))
    joined = docs.join(cuts, met, "left").drop(cut_id, cut_key)

    @F.pandas_udf("text string, n_sentences int, n_removed int, words_removed long")
    def cut(texts, intervals):
        import pandas as pd

        out = []
        for text, own in zip(texts, intervals):
            pieces = sentences(text)
            gone = np.zeros(len(pieces), bool)
            for x in own if own is not None else ():
                gone[x["start"] : x["stop"]] = True
            if gone.any():
                words = sum(len(p.encode().split()) for p, g in zip(pieces, gone) if g)
                text = "".join(p for p, g in zip(pieces, gone) if not g)
            else:
                words = 0
            out.append((text, len(pieces), int(gone.sum()), words))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "words_removed"])

    done = joined.withColumn(done_col, cut(F.col(text_col), F.col(own_cuts)))
    passed = [F.col(f"{done_col}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return done.select(*passed, *[F.col(f"{done_col}.{c}").alias(name) for c, name in zip(("n_sentences", "n_removed", "words_removed"), added)])


def op10_sentence_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, n_removed, words_removed, text`` (what is left) for every document."""
    return remove_repeated_spans(docs.select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "words_removed", "text")


def oracle_sql(window: int = WINDOW, pair_words: int = PAIR_WORDS, alone_words: int = ALONE_WORDS) -> str:
    """The same in DuckDB SQL, runs compared as texts instead of hashes. Ids must be unique."""
    ends, blank = ".!?\\n。！？", r"[ \t\n\r\x0b\x0c]+"
    unspaced = r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿\x{20000}-\x{3ffff}]"
    return rf"""
WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '[^{ends}]*[{ends}]+[\s\p{{Z}}\x0b\x1c-\x1f\x85]*|[^{ends}]+') AS l FROM documents),
p AS (SELECT doc_id, i, l[i] AS piece FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
c AS (SELECT doc_id, i, piece, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blank}', ' ', 'g'), ' ') AS plain FROM p),
n AS (SELECT *, length(plain) - length(replace(plain, ' ', '')) + CASE WHEN plain = '' THEN 0 ELSE 1 END AS words FROM c),
w AS (SELECT doc_id, i, plain, words + len(regexp_extract_all(plain, '{unspaced}')) AS size FROM n WHERE regexp_matches(piece, '[\p{{L}}\p{{N}}\p{{M}}_]')),
a AS (SELECT *, lead(plain) OVER o AS p2, lead(i) OVER o AS i2, lead(size) OVER o AS s2, string_agg(plain, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS pn, lead(i, {window - 1}) OVER o AS n_th FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i AS a, n_th AS b, pn AS run FROM a WHERE n_th IS NOT NULL UNION ALL SELECT doc_id, i, i2, plain || ' ' || p2 FROM a WHERE size + s2 >= {pair_words} UNION ALL SELECT doc_id, i, i, plain FROM a WHERE size >= {alone_words}),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM (SELECT *, min((doc_id, a)) OVER (PARTITION BY run) AS first FROM r) WHERE (doc_id, a) <> first),
k AS (SELECT n.doc_id, string_agg(piece, '' ORDER BY n.i) FILTER (g.i IS NULL) AS left_over, count(g.i) AS gone, coalesce(sum(words) FILTER (g.i IS NOT NULL), 0) AS gone_words FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
SELECT s.doc_id, coalesce(len(l), 0)::INTEGER AS n_sentences, coalesce(gone, 0)::INTEGER AS n_removed, coalesce(gone_words, 0)::BIGINT AS words_removed, CASE WHEN coalesce(gone, 0) = 0 THEN text ELSE coalesce(left_over, '') END AS text FROM s LEFT JOIN k USING (doc_id)
"""
