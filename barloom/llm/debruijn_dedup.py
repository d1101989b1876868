"""Removal of long passages that an earlier document has too, by compacted de Bruijn paths over words.

The graph's edges are k-mers of WINDOW words; two k-mers that overlap in all but one word follow each other. Runs of
consecutive k-mers are cut at places the content chooses (see anchors), so documents that share a passage cut it alike.
Such a run is a path that does not branch inside: it is one row, with the digest of its words and its coordinates
(document, first word) as source.

* A path that an earlier document has too is settled by one join on its digest: all its k-mers go.
* Where several different paths share a key, the graph branches there. Only for the first source of each such path are
  the k-mers themselves compared, again by a join.

Every removed span comes with the coordinates of its source (document, text, first word), and a second hash over the
words at both places is equal too, for whole paths and for single k-mers.

A passage of very many documents is one digest with very many rows. Digests and k-mers are folded by partial aggregates
and written, and rows are joined with the written tables, so that a hot digest is split by the planner and not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import anchors
from barloom.llm.common import Rolling, chunked, load, mix, query, stage, word_bounds, word_hashes

#: Words in a k-mer; words in the grams whose hashes choose the cuts.
WINDOW, GRAM = 50, 8
_BYTES, _WORDS, _CHECK = Rolling(31), Rolling(32), Rolling(33)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, bounds = word_bounds(raw, offsets)
    values = word_hashes(raw, start, end, _BYTES)
    return values, _WORDS.prefix(values), bounds


def _pieces(raw: np.ndarray, offsets: np.ndarray, window: int) -> anchors.Pieces:
    values, prefix, bounds = _words(raw, offsets)
    return anchors.cut(values, prefix, bounds, GRAM, window, _WORDS)


#: kmers: a hash and a second hash of every k-mer of the path.
PATHS = "key bigint, path bigint, check bigint, doc bigint, part bigint, start int, n int, kmers binary"


def paths(docs: DataFrame, documents: int, window: int = WINDOW) -> DataFrame:
    """Paths that may occur in two documents: key, digest (path, check), source coordinates and k-mer hashes."""
    wanted = docs.sparkSession.sparkContext.broadcast(
        anchors.key_filter(docs, documents, lambda raw, offsets: _pieces(raw, offsets, window), "word-keys")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunked(batches):
            values, prefix, bounds = _words(raw, offsets)
            found = anchors.cut(values, prefix, bounds, GRAM, window, _WORDS)
            keep = wanted.value.may_repeat(found.key)
            if not keep.any():
                continue
            start, n, doc = found.start[keep], found.n[keep], found.doc[keep]
            end = start + n - 1 + window
            size = (n + (found.owner[keep] - start) * 256).astype(np.uint64)
            path = mix(_WORDS.of(prefix, start, end) + size)
            second = _CHECK.prefix(values)
            check = mix(_CHECK.of(second, start, end) + size)
            place = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            kmers = np.stack((mix(_WORDS.of(prefix, place, place + window)), mix(_CHECK.of(second, place, place + window))), axis=1).astype("<u8")
            parts = [p.tobytes() for p in np.split(kmers, np.cumsum(n)[:-1])]
            ids, texts = np.asarray(batch.column("id")), np.asarray(batch.column("part"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.key[keep].view(np.int64)),
                    pa.array(path.view(np.int64)),
                    pa.array(check.view(np.int64)),
                    pa.array(ids[doc]),
                    pa.array(texts[doc]),
                    pa.array((start - bounds[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(parts, pa.binary()),
                ],
                names=[c.split()[0] for c in PATHS.split(", ")],
            )

    return docs.mapInArrow(work, PATHS)


KMERS = "key bigint, kmer bigint, check bigint, doc bigint, part bigint, start int"


def _each_kmer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch.column("n"))
        if len(n) == 0:
            continue
        kmers, check = np.frombuffer(b"".join(batch.column("kmers").to_pylist()), "<i8").reshape(-1, 2).T.copy()
        within = np.arange(len(kmers)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.asarray(batch.column("key")), n)),
                pa.array(kmers),
                pa.array(check),
                pa.array(np.repeat(np.asarray(batch.column("doc")), n)),
                pa.array(np.repeat(np.asarray(batch.column("part")), n)),
                pa.array((np.repeat(np.asarray(batch.column("start")), n) + within).astype(np.int32)),
            ],
            names=[c.split()[0] for c in KMERS.split(", ")],
        )


def repeated_spans(docs: DataFrame, documents: int, window: int = WINDOW) -> DataFrame:
    """Runs (doc, part, start, n) of k-mers that also start in a smaller id; docs: (id, text, part) without copies.

    source_doc, source_part and source_start tell where the same words start in the smallest such document; rows of one
    doc may touch or overlap.
    """
    span = ["doc", "part", "start", "n", "source_doc", "source_part", "source_start"]
    path = ["key", "path", "check"]
    source = F.min(F.struct("doc", "part", "start")).alias("source")
    from_source = [F.col(f"source.{c}").alias(f"source_{c}") for c in ("doc", "part", "start")]
    found = stage(paths(docs, documents, window), "paths")
    firsts = found.groupBy(*path).agg(source, F.count(F.lit(1)).alias("times"))
    firsts = stage(firsts.select(*path, *from_source, "times"), "firsts")
    settled = found.drop("kmers").join(firsts.filter("times > 1").drop("times"), path).filter("source_doc < doc").select(*span)
    # Of every path that leaves a branching place the rows of its first document; later ones are settled above.
    branching = stage(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("key"), "branching")
    open_paths = stage(firsts.join(branching, "key", "left_semi").select(*path, F.col("source_doc").alias("doc")), "open-paths")
    kmers = found.join(open_paths, [*path, "doc"]).select("key", "doc", "part", "start", "n", "kmers").mapInArrow(_each_kmer, KMERS)
    kmers, kmer = stage(kmers, "kmers"), ["key", "kmer", "check"]
    earliest = kmers.groupBy(*kmer).agg(source, F.max("doc").alias("latest")).filter("source.doc < latest")
    earliest = stage(earliest.select(*kmer, *from_source), "earliest")
    single = kmers.join(earliest, kmer).filter("source_doc < doc").withColumn("n", F.lit(1))
    return settled.unionByName(single.select(*span))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by single spaces) of every document.

    A word goes if it lies in a window whose words also start in a document with a smaller id, judged on the input.

    * Null and empty texts have no words; texts of fewer than `window` words lose none.
    * Rows sharing an id are one document here: they take nothing from each other, and each row loses what its own
      text shares with a smaller id. A null id is smaller than any other and is returned as null.
    * Other columns are not read. An empty table gives an empty result.
    """
    own = anchors.own_columns(docs, id_col, text_col)
    later, documents = anchors.copies(own)
    first = own.join(later, ["id", "part"], "left_anti")
    cuts = repeated_spans(first, documents, window).select("doc", "part", "start", "n")
    return anchors.with_cuts(own, later, cuts).mapInArrow(_cutter(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def _cutter(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = anchors.cut_arrays(batch.column("cuts"))
            rows = []
            for doc, text, whole, (start, n) in zip(
                batch.column("id").to_pylist(), batch.column("text"), batch.column("whole").to_pylist(), cuts
            ):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                kept = words
                if whole:
                    kept = words if len(words) < window else []
                elif len(start):
                    gone = anchors.covered(len(words), np.minimum(start, len(words)), np.minimum(n, len(words) - window + 1 - start), window)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((None if doc == anchors.NO_ID else doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept"]
                )

    return work


@query("op3_debruijn_dedup")
def _op3(spark, sf_dir):
    cut = remove_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
