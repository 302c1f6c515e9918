"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it kept, written as Parquet in the folder that all
executors share, and takes effect there. All but the last return the columns of
documents.

Defined cases: null and empty texts fail the base checks of the first stage; rows that
repeat an id count as one document for near duplicates, of which one row stays, and rows
of equal texts have one fate before that; null ids are kept as documents of their own for
each text; a very long text is one row until the last stage cuts it; without labels nothing
is learned and only the base checks and copies take rows out; an empty table gives no rows;
extra columns of any name are carried up to the last stage. Each operator's module says
more.
"""

from __future__ import annotations

import uuid

import public_tokenizers

from fathomdex.llm import mixing, ngram_join, packing, quality, toxicity
from fathomdex.llm.common import table, work_dir


def quality_rules(spark, docs, sf_dir):
    """Documents that the base checks or a learned rule reject go."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def toxic(spark, docs, sf_dir):
    """Documents that score as toxic go."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents that links connect, the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def mixed(spark, docs, sf_dir):
    """Each document as often as its source's rate and its own draw say."""
    return mixing.mix(docs)


def packed(spark, docs, sf_dir):
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: The learned rules, the compression scores and the packing are not expressible in SQL;
#: test_pipeline_stages_by_brute_force holds each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    where = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.option("compression", "zstd").parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs
