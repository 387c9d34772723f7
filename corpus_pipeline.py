"""The corpus pipeline: raw documents to sharded training data, one Parquet table per stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns;
the last returns where each document goes. A stage's rows are written to the shared folder and
read back as the next one's input, so a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from docketlake.llm.common import stage
from docketlake.llm.decontamination import drop_leaks
from docketlake.llm.mixing import mix_documents
from docketlake.llm.quality_rules import keep_good
from docketlake.llm.sharding import shard_documents
from docketlake.llm.simhash_dedup import keep_one

STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one),
    ("decontamination", drop_leaks),
    ("mixing", mix_documents),
    ("sharding", shard_documents),
]

# Fingerprints, random rounding and hashed slots have no DuckDB counterpart; tests/llm
# compares every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
