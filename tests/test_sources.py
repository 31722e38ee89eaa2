"""Documents that are written and read again."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import inputs
from plumbline.sources import documents, sinks
from conftest import SMALL


def test_question_files_hold_many_images(spark, monkeypatch):
    """The number of question files follows the amount of text, not the number of images."""
    written = []
    write = sinks.write_documents
    monkeypatch.setattr(sinks, "write_documents", lambda docs, path, folders: (written.append(path), write(docs, path, folders)))
    rows = inputs.question_files(spark, SMALL)
    assert documents.read_json_files(spark, written[0]).count() == 5  # one per subclass, as all are short
    assert rows.count() == spark.read.parquet(f"{SMALL}/conversations.parquet").where("role = 'user'").count()


@pytest.mark.parametrize("size", [1, 2000, 1 << 20])
def test_question_documents(spark, size):
    images = inputs._question_images(spark, SMALL)
    docs = sinks.question_documents(images, size)
    longest = images.agg(F.max(F.length(F.to_json("item")))).first()[0]
    assert size == 1 or docs.agg(F.max(F.length("text"))).first()[0] < 8 * (size + longest)
    columns = ("subclass", "image_path", "question", "gt_answer", "options", "task_type")
    got, want = (sorted(map(str, documents.question_rows(d).select(*columns).collect())) for d in (docs, inputs._question_files(spark, SMALL)))
    assert got == want


def test_knowledge_is_parsed_once_after_it_is_dealt(spark):
    """No condition on a parsed text repeats the parsing, or does it in the tasks that scan the compressed table."""
    plan = inputs.knowledge_scan(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert "from_json" not in plan[plan.index("RepartitionByExpression") :]
