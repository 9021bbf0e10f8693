"""

Each query derives the study tables from the given parquet folder (see
``recallspark.sources.star_schema``) and runs one operator over all of them, as of
2024-01-15 10:00.
"""

from __future__ import annotations

import json
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from recallspark.functions import clock  # noqa: E402
from recallspark.operators import candidates, cloze, dashboard, documents, idsets, imports, prompts, queue, reviews, sizing  # noqa: E402
from recallspark.plans import document_import, study_day  # noqa: E402
from recallspark.schemas import CARDS, CARD_DEFAULTS, with_defaults  # noqa: E402
from recallspark.session import settled, work_dir  # noqa: E402
from recallspark.sources import ledger, star_schema as study, summaries, tables  # noqa: E402
from recallspark.streaming import card_state  # noqa: E402

# The corpus operators may be taken away; everything else works without them.
try:
    from recallspark.llm import queries as corpus
    import corpus_pipeline
except ImportError:
    corpus = corpus_pipeline = None

AS_OF = study.AS_OF
FLAGSHIP_DIR = "/root/testdata/sf0.001"


@lru_cache
def _ship_package(spark: SparkSession) -> None:
    """Send the code to the Python workers, for the two operators that run Python."""
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="recallspark-code-")) / "recallspark_code.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for file in [root / "__spark_entry__.py", *sorted((root / "recallspark").rglob("*.py"))]:
            bundle.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def _scored(spark, d):
    return candidates.priority_scores(
        study.cards(spark, d), study.subjects(spark, d), study.recommendation_logs(spark, d), AS_OF
    )


def _on_cards(op):
    return lambda spark, d: op(study.cards(spark, d))


def _on_logs(op, **options):
    return lambda spark, d: op(study.recommendation_logs(spark, d), AS_OF, **options)


def _on_scored(op, **options):
    return lambda spark, d: op(_scored(spark, d), study.recommendation_logs(spark, d), AS_OF, **options)


def _on_reviews(op, **options):
    return lambda spark, d: op(study.cards(spark, d), study.reviews(spark, d), **options)


def _history(**options):
    def run(spark, d):
        rows = reviews.review_history(study.cards(spark, d), study.reviews(spark, d), **options)
        return rows.withColumn("reviewed_at", clock.moment_text(F.col("reviewed_at")))

    return run


def _points(spark, d):
    return prompts.completion_points(study.completions(spark, d))


def _pairs(spark, d):
    return prompts.completion_cards(study.pairs_completions(spark, d))


def _progress(spark, d, **options):
    return dashboard.subject_progress(study.cards(spark, d), study.subjects(spark, d), **options)


def _stream_card_state(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream, drained; then the latest state of each reviewed card."""
    graded = study.reviews_of(study.review_events(spark, d))
    folder = f"{work_dir(spark)}/card-stream-{uuid.uuid4().hex}"
    card_state.write_deltas(graded, f"{folder}/deltas", f"{folder}/checkpoint").awaitTermination()
    return card_state.latest_states(spark, f"{folder}/deltas", study.cards(spark, d))


def open_stand_in():
    """A deterministic stand-in for a model: it counts characters, and fails on some texts.

    JSON mode fails on even lengths, both modes on multiples of seven; without JSON
    mode the answer comes in a code fence.
    """

    def model(messages, json_mode):
        request = messages[1]["content"]
        if request.startswith("Study text:"):
            n = len(request) - len("Study text:\n\n")
            if n % 7 == 0 or (json_mode and n % 2 == 0):
                raise RuntimeError("no answer")
            body = json.dumps({"points": [f"{n} characters"]})
        else:
            lines = [line.split(". ", 1)[1] for line in request.split("\n")[2:]]
            pairs = [{"q": "____ " + line.split(" ", 1)[1], "a": line.split(" ", 1)[0]} for line in lines]
            body = json.dumps({"knowledge_points": pairs})
        return body if json_mode else f"```json\n{body}\n```"

    return model


def _completed_prompts(spark, d):
    _ship_package(spark)
    return prompts.complete(prompts.point_prompts(study.documents(spark, d)), open_stand_in)


def _kept_prompts(spark, d):
    """The answers of a second run, which finds those of the first in the store."""
    _ship_package(spark)
    store = f"{work_dir(spark)}/answers-{uuid.uuid4().hex}"
    asked = prompts.point_prompts(study.documents(spark, d))
    prompts.complete_kept(asked.where("doc_id % 2 = 0"), open_stand_in, store)
    return prompts.complete_kept(asked, open_stand_in, store)


def _import(spark, d, model=None):
    """Uploaded files and PDF pages to cards, import rows and a report."""
    _ship_package(spark)
    return document_import.import_files(
        study.document_files(spark, d), study.document_pages(spark, d), study.cards(spark, d),
        study.imported_files(spark, d), AS_OF, model)


def _model_import_report(spark, d):
    lines = F.transform("errors", lambda e: F.concat_ws(":", e["step"].cast("string"), e["part"].cast("string"), e["error"]))
    return _import(spark, d, open_stand_in).report.withColumn("errors", F.array_join(lines, ","))


def _declared_tables(spark, d):
    """Tables declared in a database of their own, filled, declared again, and read; the database goes again."""
    name = f"study_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        tables.create_tables(spark, name, card_buckets=4)
        study.cards(spark, d).write.insertInto(f"{name}.cards")
        study.subjects(spark, d).write.insertInto(f"{name}.subjects")
        tables.create_tables(spark, name, card_buckets=4)
        owned = spark.table(f"{name}.cards").join(spark.table(f"{name}.subjects").select(F.col("id").alias("subject_id"), "name"), "subject_id")
        return settled(owned.select("id", "question", "ignored", F.col("name").alias("subject_name")))
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _stored_tables(spark, d):
    """Tables kept through a day: files of different columns, logs of any text, cards appended while a snapshot is made, a run tried twice."""
    folder = f"{work_dir(spark)}/study-{uuid.uuid4().hex}"
    cards, logs = study.cards(spark, d), study.recommendation_logs(spark, d)
    # Old and new files directly in one folder, and appended ones.
    cards.where("id % 4 = 0").drop("ignored").write.parquet(f"{folder}/cards")
    cards.where("id % 4 = 2").write.mode("append").parquet(f"{folder}/cards")
    tables.append_rows(cards.where("id % 4 = 1"), folder, "cards")
    odd = F.expr("CASE id % 30 WHEN 0 THEN 'never' WHEN 10 THEN '2024-1-5 10:00:00' ELSE recommended_at END")
    logs = logs.withColumn("recommended_at", F.when(F.col("id") % 40 != 0, odd))
    tables.append_logs(logs.where("id % 20 = 0"), folder)
    tables.append_rows(logs.where("id % 20 <> 0"), folder, "recommendation_logs")
    read = tables.card_version(spark, folder)
    graded = study_day.close_day(tables.load_cards(spark, folder, read), study.reviews(spark, d))
    tables.append_rows(cards.where("id % 8 = 3"), folder, "cards")
    for _ in range(2):
        tables.write_snapshot(graded, folder, "2024-01-15", read)
    tables.append_rows(cards.where("id % 8 = 7"), folder, "cards")
    # The same run once more, of what is there now.
    now = tables.load_tables(spark, folder)
    tables.write_snapshot(now["cards"], folder, "2024-01-15", now.card_version)
    stored = tables.load_tables(spark, folder)
    kept = stored["cards"].select(
        F.lit("card").alias("kind"), "id", "mastery_level", "ignored", "review_count", F.col("last_reviewed_at").alias("at"))
    empty = [F.lit(None).cast(kept.schema[c].dataType) for c in ("mastery_level", "ignored", "review_count")]
    of_day = tables.load_logs(spark, folder, AS_OF.date()).select(F.lit("log of the day"), "id", *empty, "recommended_at")
    return kept.unionAll(stored["recommendation_logs"].select(F.lit("log"), "id", *empty, "recommended_at")).unionAll(of_day)


def _summed_parts(spark, d):
    """The dashboard from sums per stored part: looked at before and after an append and a snapshot."""
    folder = f"{work_dir(spark)}/study-{uuid.uuid4().hex}"
    cards = study.cards(spark, d)
    tables.append_rows(cards.where("id % 3 = 0"), folder, "cards")
    summaries.summarise_new(spark, folder, tables.card_version(spark, folder))
    tables.append_rows(cards.where("id % 3 = 1"), folder, "cards")
    read = tables.load_tables(spark, folder)
    tables.write_snapshot(study_day.close_day(read["cards"], study.reviews(spark, d)), folder, "day", read.card_version)
    tables.append_rows(cards.where("id % 3 = 2"), folder, "cards")
    return summaries.stored_summary(spark, folder)


def _reserved_subjects(spark, d):
    """Two batches of subjects planned before either is written, each with ids of its own."""
    folder = f"{work_dir(spark)}/study-{uuid.uuid4().hex}"
    subjects, offered = study.subjects(spark, d), study.offered_subjects(spark, d)
    made = []
    for part in (0, 1):
        entries = offered.where(f"form_id % 2 = {part}")
        after = ledger.reserve_ids(subjects, folder, "subjects", ledger.id_count(entries.where("name <> ''")))
        made.append(imports.new_subjects(entries, subjects, "form_id", after))
    return made[0].unionAll(made[1])


def _unlogged_cards(spark, d):
    """Learning cards that the logs of all days do not name, filtered by bit maps."""
    logged = study.recommendation_logs(spark, d).select(F.col("card_id").alias("id"))
    learning = candidates.learning_cards(study.cards(spark, d))
    return idsets.without_ids(learning, logged, sizing.BROADCAST_BYTES + 1).select("id", "mastery_level")


def entry(spark: SparkSession) -> DataFrame:
    """The top cards to review, on the smallest data set."""
    return queries()["top_priority_cards"](spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # Tables, conditions
        "all_subjects": study.subjects,
        "live_cards": _on_cards(candidates.live_cards),
        "learning_cards": _on_cards(candidates.learning_cards),
        "schema_backfill": _on_cards(lambda c: with_defaults(c.drop("ignored"), CARDS, CARD_DEFAULTS)),
        "cards_reviewed_on_day": _on_cards(
            lambda c: c.where(clock.on_day_filter(F.col("last_reviewed_at"), AS_OF.date())).select("id", "last_reviewed_at")),
        "card_by_id": _on_cards(lambda c: c.where(F.col("id") == 42)),
        # Scores, queue
        "review_candidates": lambda spark, d: candidates.review_candidates(
            study.cards(spark, d), study.subjects(spark, d), study.recommendation_logs(spark, d), AS_OF),
        "priority_scores": _scored,
        "ranked_cards": lambda spark, d: queue.ranked_cards(_scored(spark, d)).select("id", "priority_score", "position"),
        "reason_counts": lambda spark, d: candidates.reason_counts(_scored(spark, d)),
        "recommended_card": _on_scored(queue.recommended_card),
        "recommended_log_row": lambda spark, d: queue.recommended_log_row(
            queue.recommended_card(_scored(spark, d), study.recommendation_logs(spark, d), AS_OF),
            study.recommendation_logs(spark, d), AS_OF),
        "top_priority_cards": _on_scored(queue.top_priority_cards),
        "top_card_lines": _on_scored(lambda *a: queue.card_lines(queue.top_priority_cards(*a))),
        "recommendations_on_day": _on_logs(queue.recommendations_on_day),
        "quota_status": _on_logs(queue.quota_status),
        "quota_status_limit_5": _on_logs(queue.quota_status, daily_limit=5),
        "quota_line": _on_logs(dashboard.quota_line),
        "daily_queue": _on_scored(lambda *a: queue.daily_queue(*a)[0]),
        "daily_queue_limit_20": _on_scored(lambda *a: queue.daily_queue(*a, daily_limit=20)[0]),
        "queue_log_rows": _on_scored(lambda *a: queue.daily_queue(*a)[1]),
        "random_card": _on_cards(lambda c: queue.random_card(c, seed=7)),
        # Totals, progress
        "dashboard_totals": _on_cards(lambda c: dashboard.dashboard_totals(c, AS_OF)),
        "total_lines": _on_cards(lambda c: dashboard.total_lines(dashboard.dashboard_totals(c, AS_OF))),
        "subject_progress": _progress,
        "subject_progress_strict": lambda spark, d: _progress(spark, d, count_missing=False),
        "progress_lines": lambda spark, d: dashboard.progress_lines(_progress(spark, d)),
        "subject_imports": lambda spark, d: dashboard.subject_imports(study.imported_files(spark, d)),
        "subjects_view": lambda spark, d: dashboard.subjects_view(study.subjects(spark, d), study.imported_files(spark, d)),
        "subject_names": lambda spark, d: dashboard.subject_names(study.subjects(spark, d)),
        # Grades
        "grade_steps": _on_reviews(reviews.grade_steps),
        "review_history": _history(),
        "review_history_ranged": _history(hot_reviews=18),
        "cards_after_reviews": _on_reviews(reviews.apply_reviews),
        "stream_card_state": _stream_card_state,
        # Documents to cards
        "document_routes": lambda spark, d: documents.route_documents(study.document_files(spark, d))
        .select("doc_id", "file_name", "mime_type", "kind"),
        "decoded_documents": lambda spark, d: documents.decode_documents(study.document_files(spark, d))
        .select("doc_id", "file_name", "text"),
        "pages_text": lambda spark, d: documents.pages_to_text(study.document_pages(spark, d)),
        "document_texts": lambda spark, d: document_import.document_texts(
            study.document_files(spark, d), study.document_pages(spark, d)).select("doc_id", "file_name", "text"),
        "point_prompts": lambda spark, d: prompts.point_prompts(study.documents(spark, d)),
        "completion_points": lambda spark, d: _points(spark, d).select(
            "doc_id", F.size("points").alias("found"), F.array_join("points", "|").alias("points")),
        "numbered_points": lambda spark, d: prompts.numbered_points(_points(spark, d)),
        "card_prompts": lambda spark, d: prompts.card_prompts(_points(spark, d)),
        "completion_cards": lambda spark, d: _pairs(spark, d).select("doc_id", F.posexplode("pairs").alias("pos", "pair"))
        .select("doc_id", "pos", "pair.q", "pair.a"),
        "cards_json": lambda spark, d: prompts.cards_json(_pairs(spark, d)),
        # Numbering reads the pairs twice, so the answers are parsed once and written.
        "imported_cards": lambda spark, d: imports.new_cards(settled(_pairs(spark, d)), study.cards(spark, d), AS_OF),
        "imported_file_rows": lambda spark, d: imports.new_import_rows(
            _pairs(spark, d).where(F.size("pairs") > 0), study.imported_files(spark, d), AS_OF),
        "import_report": lambda spark, d: imports.import_report(
            study.documents(spark, d), imports.card_counts(_pairs(spark, d))),
        "added_subjects": lambda spark, d: imports.new_subjects(
            study.offered_subjects(spark, d), study.subjects(spark, d), "form_id"),
        "completed_prompts": _completed_prompts,
        "completed_prompts_kept": _kept_prompts,
        "unlogged_cards_by_bit_map": _unlogged_cards,
        "summed_totals": lambda spark, d: dashboard.totals_of(_summed_parts(spark, d), AS_OF),
        "summed_progress": lambda spark, d: dashboard.progress_of(_summed_parts(spark, d), study.subjects(spark, d)),
        "reserved_subjects": _reserved_subjects,
        "model_import_cards": lambda spark, d: _import(spark, d, open_stand_in).card_rows,
        "model_import_report": _model_import_report,
        "stored_tables": _stored_tables,
        "declared_tables": _declared_tables,
        "cloze_import_rows": lambda spark, d: _import(spark, d).import_rows,
        "cloze_import_cards": lambda spark, d: _import(spark, d).card_rows,
        "cloze_import_report": lambda spark, d: _import(spark, d).report,
        "cloze_cards": lambda spark, d: cloze.cloze_cards(study.documents(spark, d)),
    } | corpus_queries()


def corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {} if corpus is None else corpus.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from oracles import SQL

    if corpus is None:
        return dict(SQL)
    return SQL | corpus.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
