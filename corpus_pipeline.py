"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from barloom.llm.common import load, prepare, stage
from barloom.llm.exact_dedup import keep_one
from barloom.llm.line_crf import keep_good
from barloom.llm.parity_join import keep_representatives
from barloom.llm.prefix_bpe import encode_stage
from barloom.llm.template_decontam import keep_clean

#: Not expressible in SQL: the first stage fits a model.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents whose lines are mostly good."""
    prepare(spark)
    return keep_good(docs, load(spark, sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    """One of every group of equal texts."""
    prepare(spark)
    return keep_one(docs)


def near(spark, docs, sf_dir):
    """One of every group linked by at least 80 percent of common five-word shingles."""
    prepare(spark)
    return keep_representatives(docs, width=5, percent=80)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    prepare(spark)
    return keep_clean(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Token ids of what is left: doc_id, n_tokens, ids."""
    prepare(spark)
    return encode_stage(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokens),
]


def run(spark, sf_dir):
    """All stages over the documents; what each returns is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for at, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stage(docs, f"stage-{at}")
    return docs
