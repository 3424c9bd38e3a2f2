from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import models, scoring
from scriptorium.plans.config import Config
from scriptorium.plans.drivers import Steps
from scriptorium.plans.main import main
from scriptorium.sources import files

TEXT = "A first paragraph of words.\r\n\r\nA second paragraph — with a dash.\r\n\r\nMute paragraph of words."


def voice():
    def say(text):
        if text.startswith("Mute"):
            raise ValueError("no voice")
        return models.tone_speaker()(text)

    return say


def half_deaf():
    return lambda wav: t if (t := models.tone_reader()(wav)).isascii() else ""


def deaf():
    return lambda wav: ""


def size(text, gap):
    return 2 * len(text) + gap * 24000 * 360 // 1000 * 2


def test_modes(spark, tmp_path):
    (tmp_path / "Book.txt").write_bytes(TEXT.encode())
    out = tmp_path / "out"
    cfg = dict(input=str(tmp_path / "Book.txt"), out_dir=str(out), max_words=0, validate=True)
    steps = lambda ear: Steps(speak=voice, transcribe=ear, lexicon=scoring.sample_lexicon(spark), rewrite=lambda: lambda t: t.replace("words", "letters"), transcode=models.command(["cat"]))
    assert main(spark, Config(**cfg, llm_clean=True), steps(half_deaf)) == 1  # one couldn't be spoken
    assert (tmp_path / "book_cleaned.txt").read_text().startswith("A first paragraph of letters.\n\nA second")
    one, two = "A first paragraph of letters.", "A second paragraph with a dash."
    assert len((out / "combined.wav").read_bytes()) == 44 + size(one, 1) + size(two, 1)
    assert sorted(p.name for p in out.glob("paragraph*")) == ["paragraph_001.transcription.txt", "paragraph_001.wav", "paragraph_002.transcription.txt", "paragraph_002.wav"]
    run = files.run_records(spark, str(out / "run.json")).first()
    assert [(c.ordinal, c.status.status) for c in run.chunks] == [(1, "Ok"), (2, "Ok"), (3, "Failed")] and run.llm_clean.changed and run.llm_clean.words_before == 16

    (out / "paragraph_001.wav").unlink()
    assert main(spark, Config(**cfg, merge_only=True, to_mp3=True), steps(deaf)) == 0
    assert len((out / "combined.wav").read_bytes()) == 44 + size(two, 1) == len((out / "combined.mp3").read_bytes())

    assert main(spark, Config(**cfg), steps(deaf)) == 1
    assert (out / "paragraph_001.bad.txt").read_text().startswith("ORIGINAL:\nA first paragraph of words.\n\nTRANSCRIPTION:\n\n")
    assert main(spark, Config(**cfg, fix_quarantine=True), steps(half_deaf)) == 0
    run = files.run_records(spark, str(out / "run.json")).first()
    assert [c.status.status for c in run.chunks] == ["Ok", "Ok", "Failed"] and not list(out.glob("*.bad.txt"))


def test_pdfs_by_a_callers_parser(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"A first paragraph of words.")
    cfg = Config(input=str(tmp_path / "x.txt"), out_dir=str(tmp_path / "out"), rip_pdf=str(tmp_path / "x.pdf"), rip_pdf_only=True)
    assert main(spark, cfg, Steps(speak=voice), lambda pdfs: pdfs.select("doc_id", F.col("content").cast("string").alias("text"))) == 0
    assert (tmp_path / "x.txt").read_text() == "A first paragraph of words."


def test_sources(spark, tmp_path):
    for name in ("b.txt", "A.TXT", "c.Pdf", "d.md"):
        (tmp_path / name).write_text("x")
    assert [(r.stem, r.kind) for r in files.inbox(spark, str(tmp_path)).collect()] == [("a", "txt"), ("b", "txt"), ("c", "pdf")]
    assert files.text_files(spark, str(tmp_path / "b.txt")).first().text == "x"
    (tmp_path / "lex").write_text(";;; note\nB  B IY1\nA(1)  AH0\nA  EY1\n\n")
    assert {r.word: r.phones for r in scoring.parse_lexicon(files.lexicon_lines(spark, str(tmp_path / "lex"))).collect()} == {"b": ["B", "IY"], "a": ["AH"]}
    (tmp_path / "w.wav").write_bytes(b"RIFF")
    assert [r.id.rsplit("/", 1)[-1] for r in files.wav_files(spark, str(tmp_path)).collect()] == ["w.wav"]
    odd = spark.createDataFrame([("\u00a0x\u2003",)], "x string")
    assert odd.select(T.trimmed(F.col("x"))).first()[0] == "x"
