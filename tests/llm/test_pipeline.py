"""The pipeline, stage by stage, against plain Python over a small table; and the entry without it."""

import re
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from test_decontaminate import brute as hits
from test_near_join import brute as near

import corpus_pipeline
from sectorpulse.llm import encoding, quality
from sectorpulse.llm.common import vocabulary

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, written and read again as the driver does."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], DATA).write.parquet(f"{folder}/{k}")
        found.append(spark.read.parquet(f"{folder}/{k}"))
    return found


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_what_is_drawn(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    drawn = quality.resample(stages[0], labels).collect()
    assert rows(stages[1]) == sorted((r.doc_id, r.text) for r in stages[0].collect() if r.doc_id in {d.id for d in drawn if d.kept})
    assert sum(d.kept for d in drawn) == sum(d.weight is not None and d.weight >= 0 for d in drawn)


def test_exact_copies(stages):
    groups = {}
    for doc, text in rows(stages[1]):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc, text))
    assert rows(stages[2]) == sorted((doc, text) for _, doc, text in map(min, groups.values()))


def test_near_copies(stages):
    given = rows(stages[2])
    keep = {doc for doc, _, least in near(given, 5, 80) if doc == least}
    assert rows(stages[3]) == [(doc, text) for doc, text in given if doc in keep]


def test_contaminated_documents(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {doc for doc, *_, contaminated in hits(rows(stages[3]), items, 13) if contaminated}
    assert bad and rows(stages[4]) == [(doc, text) for doc, text in rows(stages[3]) if doc not in bad]


def test_packed_pieces(stages):
    encode = encoding.word_level(vocabulary(corpus_pipeline.TOKENIZER))
    wanted = []
    for doc, text in rows(stages[4]):
        ids = encode(text) + bytes(4)
        wanted += [(doc, k, zlib.crc32(ids[a : a + 8192])) for k, a in enumerate(range(0, len(ids), 8192))]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect()) == wanted


def test_entry_without_the_training_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [n for n in q if n[:2] == 'op' and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_every_operator_is_registered():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
