"""From raw documents to shuffled shards, each stage written and read again.

Stages: quality rules reject documents; of near duplicates (five-word shingles,
similarity 0.8) one stays; documents that hold a benchmark item go; sources are
mixed to their target weights, which repeats and drops documents; the mix is
shuffled into shards. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from ratecraft.llm.common import load, written
from ratecraft.llm.decontaminate import drop_contaminated
from ratecraft.llm.jaccard import keep_one
from ratecraft.llm.mixing import mixed
from ratecraft.llm.quality_rules import keep_good
from ratecraft.llm.sharding import sharded


def quality_stage(spark, docs, sf_dir):
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    return keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark, docs, sf_dir):
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    return mixed(docs)


def sharding_stage(spark, docs, sf_dir):
    return sharded(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs


#: Newton steps and seeded shuffles aren't SQL; tests compare with brute force.
ORACLE_SQL = None
