"""Streams with state: the lives of jobs, and edits of indexed lines."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import commits, lexical
from quillmark.streaming import edits, jobs

START = datetime(2024, 5, 1, tzinfo=UTC)
EVENTS = "job_id string, at timestamp, seq long, status string, message string"


def told(spark, tmp_path, batches, runs=1, **options):
    """What is told of events that arrive in batches; the query ends and starts again between runs."""
    order = 0
    per = -(-len(batches) // runs)
    for run in range(runs):
        for rows in batches[run * per : (run + 1) * per]:
            at = tmp_path / "part"
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").json(str(at))
            (tmp_path / "in").mkdir(exist_ok=True)
            next(at.glob("*.json")).rename(tmp_path / "in" / f"{order:03}.json")
            order += 1
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = jobs.lives(source, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    rows = spark.read.schema(jobs.TOLD).parquet(str(tmp_path / "out")).collect()
    minutes = lambda t: round((t.astimezone(UTC) - START).total_seconds() / 60, 3)
    return sorted(((r.job_id, minutes(r.at), r.seq, r.status, r.message) for r in rows), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))


def event(job, minute, seq, status, message=""):
    return job, START + timedelta(minutes=minute), seq, status, message


def test_silent_jobs_fail_and_late_events_take_their_place(spark, tmp_path):
    run, done = jobs.RUNNING, "fertig"
    batches = [
        [event("a", 0, 1, run, "x"), event("b", 0, 2, run), event("c", 5, 3, run)],
        [event("a", 20, 5, run), event("b", 50, 6, done), event(None, 50, 7, run), ("d", None, 8, run, "")],
        [event("a", 45, 9, done), event("c", 43, 10, run)],  # older than the newest, within the delay
        [event("z", 300, 11, run)],
    ]
    found = told(spark, tmp_path, batches, idle="30 minutes", delay="10 minutes")
    silent = lambda job, minute: (job, minute, None, jobs.FAILED, jobs.SILENT)
    assert found == [
        ("a", 0.0, 1, run, "x"), ("a", 20.0, 5, run, ""), ("a", 45.0, 9, done, ""),
        ("b", 0.0, 2, run, ""), silent("b", 30.0), ("b", 50.0, 6, done, ""),
        ("c", 5.0, 3, run, ""), silent("c", 35.0), ("c", 43.0, 10, run, ""), silent("c", 73.0),
    ]


@pytest.mark.parametrize("runs", [1, 3])
def test_lives_equal_the_ordered_events(spark, tmp_path, runs):
    rng = random.Random(runs)
    rows = [event(rng.choice("abcd"), rng.randint(0, 900), k, rng.choice((jobs.RUNNING, jobs.RUNNING, "fertig", "wartend"))) for k in range(120)]
    arriving = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.random() * 29))
    batches = [arriving[k : k + 20] for k in range(0, 120, 20)]
    found = told(spark, tmp_path, batches, runs, idle="45 minutes", delay="30 minutes")
    watermark = max(r[1] for r in rows) - timedelta(minutes=30)
    want = []
    for job in "abcd":
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == job)
        for k, (at, seq, status) in enumerate(mine):
            if at > watermark:
                continue
            after = mine[k + 1][0] if k + 1 < len(mine) else None
            want.append((job, (at - START).total_seconds() / 60, seq, status, ""))
            end = at + timedelta(minutes=45)
            if status == jobs.RUNNING and end <= watermark and (after is None or after > end):
                want.append((job, (end - START).total_seconds() / 60, None, jobs.FAILED, jobs.SILENT))
    assert found == sorted(want, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)) and len(found) > 100


def test_edits_leave_the_postings_of_the_latest_states(spark, tmp_path):
    rng = random.Random(5)
    words = ["Haus", "Müller", "am", "See", "Straße", "1872"]
    archive = commits.Snapshots(spark, str(tmp_path / "archive"))
    states, n = {}, 0
    (tmp_path / "in").mkdir()
    for run in range(3):
        for _ in range(3):
            rows = [(rng.choice("abcdefgh"), rng.randint(0, 30), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(6)]
            rows = [(k, s, t if s % 7 else None) for k, s, t in {(k, s): (k, s, t) for k, s, t in rows if (k, s) not in states}.values()]
            states |= {(k, s): t for k, s, t in rows}
            at = tmp_path / "part"
            again = rng.choice(list(states.items()))  # repeated
            rows += [(*again[0], again[1]), (None, 1, "x"), ("i", None, "x")]
            spark.createDataFrame(rows, "line_id string, seq long, text string").coalesce(1).write.mode("overwrite").parquet(str(at))
            next(at.glob("*.parquet")).rename(tmp_path / "in" / f"{n:03}.parquet")
            n += 1
        source = spark.readStream.schema("line_id string, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        edits.follow(source, archive, str(tmp_path / "state")).awaitTermination()
        if run == 1:
            edits.compact(archive)
        latest = {}
        for (k, s), t in sorted(states.items()):
            latest[k] = t
        lines = text.compose(spark.createDataFrame([(k, t or "") for k, t in latest.items()], "line_id string, text string"), "text").withColumn("normalized", text.normalize(F.col("text")))
        want = sorted(map(tuple, lexical.postings(lines).collect()))
        assert sorted(map(tuple, edits.current(archive).collect())) == want and want
    assert ("mueller", "a") in {(t, "a") for t, *_ in want}
    # a batch whose commit was made, but not noted by the stream, is not applied again
    rows = spark.createDataFrame([("a", 99, "zweimal", None)], edits.CHANGE)
    for _ in range(2):
        archive.update(lambda t: edits._commit(t, rows, "edits", 1000))
    assert edits.current(archive).where("token = 'zweimal'").count() == 2  # in both columns, once each
