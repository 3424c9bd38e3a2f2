from pyspark.sql import functions as F

from scriptorium.operators import models, records
from scriptorium.plans.config import Config
from scriptorium.plans.drivers import Steps
from scriptorium.sources import files
from scriptorium.streaming import batch


def voice():
    def say(text):
        if text.startswith("Mute"):
            raise ValueError("no voice")
        return models.tone_speaker()(text)

    return say


def folder(root, **texts):
    (root / "in").mkdir(parents=True)
    for name, text in texts.items():
        (root / "in" / f"{name}.txt").write_text(text)
    return str(root)


def names(root, sub):
    return sorted(p.name for p in (root / sub).glob("[!.]*")) if (root / sub).exists() else []


def test_batch_runs_routes_and_clears(spark, tmp_path):
    root = folder(tmp_path, A="A paragraph of words.\n\nAnother paragraph here.", b="Spoken paragraph here.\n\nMute paragraph here.", empty="short", mute="Mute paragraph alone.")
    (tmp_path / "in" / "note.md").write_text("left alone")
    batch.run_batch(spark, root, Steps(speak=voice), Config())
    assert names(tmp_path, "in") == ["note.md"] and names(tmp_path, "pdf_completed") == ["A.txt", "b.txt", "empty.txt", "mute.txt"]
    assert names(tmp_path, "audio") == ["a.mp3", "b_part.mp3", "mute_picturebook.txt"]  # no marker where there was nothing to say
    assert names(tmp_path, "text_completed") == ["a.txt", "b.txt", "empty.txt", "mute.txt"]
    assert (tmp_path / "audio" / "mute_picturebook.txt").read_text() == "no audio produced for mute\nchunks=1, failed=1, quarantined=0\n"
    data = (tmp_path / "audio" / "a.mp3").read_bytes()
    gap = 24000 * 360 // 1000 * 2
    assert len(data) == 44 + 2 * len("A paragraph of words.Another paragraph here.") + gap
    assert not (tmp_path / "batch.log").exists()


def test_poisoned_files_go_and_only_their_own_strikes_count(spark, tmp_path):
    root = folder(tmp_path, bad="A paragraph of words.", good="Another paragraph here.")
    seen = []

    class Crash(BaseException):
        """Ends the program as a crash does: no handler of the batch sees it."""

    def crash(rows, path):
        seen.extend(r["pdf"] + ":" + r["event"] for r in rows.collect())
        files_append(rows, path)
        if seen[-1] == "bad.txt:start":
            raise Crash

    files_append = batch.append_log
    for _ in range(2):
        batch.append_log = crash
        try:
            batch.run_batch(spark, root, Steps(speak=voice), Config())
        except Crash:
            pass
        finally:
            batch.append_log = files_append
    struck = {r["pdf"]: r["strikes"] for r in records.strikes(files.batch_log(spark, f"{root}/batch.log")).collect()}
    assert struck == {"bad.txt": 2} and seen == ["bad.txt:start"] * 2
    batch.run_batch(spark, root, Steps(speak=voice), Config())
    assert names(tmp_path, "pdf_errored") == ["bad.txt"] and names(tmp_path, "pdf_completed") == ["good.txt"]


def test_a_failing_job_fails_its_files(spark, tmp_path):
    root = folder(tmp_path, one="A paragraph of words.")
    (tmp_path / "in" / "two.pdf").write_bytes(b"%PDF")
    batch.run_batch(spark, root, Steps(speak=voice), Config())  # no parser for PDFs
    assert names(tmp_path, "pdf_errored") == ["two.pdf"] and names(tmp_path, "pdf_completed") == ["one.txt"]


def test_a_stream_starts_batches(spark, tmp_path):
    root = folder(tmp_path / "r", A="A paragraph of words.")
    batch.watch(spark, root, str(tmp_path / "cp"), Steps(speak=voice), Config()).trigger(availableNow=True).start().awaitTermination()
    assert names(tmp_path / "r", "audio") == ["a.mp3"]


def test_log_of_odd_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    assert files.batch_log(spark, path).count() == 0
    files.append_log(spark.createDataFrame([(None, "a.txt", "start", None, None, None)], records.LOG), path)
    (tmp_path / "log" / "x.json").write_text('{"pdf": "b.txt", "event": "start"}\nno json\n')
    assert sorted(r["pdf"] for r in files.batch_log(spark, path).where(F.col("event") == "start").collect()) == ["a.txt", "b.txt"]
    files.clear_log(spark, path)
    assert files.batch_log(spark, path).count() == 0
