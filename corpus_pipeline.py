"""The corpus pipeline: stages over documents, each one operator of the training-data subpackage.

Language ID drops documents whose language it can't tell, MinHash near-dedup (five-word shingles, 0.8) keeps one
document of each group, the secret scan replaces secrets, mixing takes documents none, one or two times, and
packing cuts the corpus into sequences of 1024 tokens."""

from quillrank.llm import langid, minhash, mixing, packing, secret_scan
from quillrank.llm.common import dropped, noted, written

#: Intermediate tables of the stage before; they go once its rows have been written, that is, when the next stage starts.
_left: list[str] = []


def _stage(operator):
    def run(spark, docs, sf_dir):
        dropped(spark, _left, docs)
        with noted(_left):
            return operator(docs)

    return run


@_stage
def language(docs):
    return langid.keep_identified(docs, langid.train(docs))


@_stage
def near_duplicates(docs):
    return minhash.deduplicated(docs, width=5, percent=80)


@_stage
def secrets(docs):
    return secret_scan.redact(docs, length="n_chars")


@_stage
def mixing_stage(docs):
    return mixing.mix(docs)


@_stage
def packing_stage(docs):
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't train the classifier or tokenize; tests hold each stage against a plain version on a small table.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents in turn, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else written(docs)
    return docs
