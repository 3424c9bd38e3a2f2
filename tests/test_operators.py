import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import audio, chunking, layout, models, records, scoring
from scriptorium.plans import drivers
from scriptorium.plans.config import Config, parse
from scriptorium.sources import files


def column(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def chunked(spark, text, low, most):
    return [(r.text, r.trailing_boundary) for r in chunking.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), low, most).orderBy("ordinal").collect()]


def test_chunks(spark):
    assert [b for _, b in chunked(spark, "First.\n\nSecond.", 3, 0)] == ["Paragraph", None]
    words = " ".join(f"word{i}" for i in range(250))
    assert [len(t.split()) for t, _ in chunked(spark, words, 1, 200)] == [199, 51]
    assert [b for _, b in chunked(spark, words + "\n\nShort second.", 3, 200)] == ["Sentence", "Paragraph", None]
    assert chunked(spark, "One.\n\nTwo.\n\nThree.", 1, 0)[-1] == ("Three.", None)
    assert chunked(spark, "", 1, 0) == []


def test_split_words_keeps_every_word():
    text = "a b. c d e f. g"
    for most in (1, 2, 3, 5):
        assert " ".join(chunking.split_words(text, most)).split() == text.split()


def test_lines(spark):
    assert column(spark, T.hyphens_rejoined, "perturba-\ntion is key", "end—\nnext", "NASA-\nJohnson") == ["perturbation is key", "end—\nnext", "NASA-\nJohnson"]
    assert column(spark, T.glyphs_scrubbed, "ef[fi]cient", "text[bullet]more", "te[uni0041]xt", "see [1] for details", "[bracketleft]fi[bracketright]") == ["efficient", "textmore", "text", "see [1] for details", "fi"]
    assert column(spark, T.is_page_number, "42", " - 7 - ", "Section 4", "---") == [True, True, False, True]
    assert column(spark, T.is_reference_heading, "References", "  bibliography  ", "Reference architecture", "7. References", "(7) References", "Appendix A: Derivations", "References:", "7.") == [True, True, False, True, True, True, False, False]
    assert column(spark, T.is_caption, "Figure 3. Thrust profile.", "Table 2: Summary", "Fig. 1 shows", "Figuratively speaking") == [True, True, True, False]
    assert column(spark, T.is_noise, "Short tail:", "Short tail.", "ABSTRACT OF A LONG TITLE IN CAPITALS HERE", "10.1234/abcdefghijklmnopqrstuvwxyz0123456789") == [True, False, False, True]


def test_scalars(spark):
    assert column(spark, T.sanitized, "café — ok") == ["caf ok"]
    assert column(spark, T.normalized, "Don’t stop—at 3.2 km") == ["dont stop at km"]
    assert column(spark, T.terminated, "Hello", "Hello.", "He said “hi”") == ["Hello.", "Hello.", "He said “hi”."]
    assert column(spark, T.think_stripped, "<think>x</think> hi", "plain") == ["hi", "plain"]
    assert column(spark, T.stem, "/in/A.pdf", "b") == ["a", "b"]


def test_paragraphs_and_layout(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["First sentence.", "Second sentence.", "", "New paragraph."])], "doc_id int, line_no int, text string")
    assert [r.text for r in layout.lines_to_paragraphs(lines).orderBy("para").collect()] == ["First sentence. Second sentence.", "New paragraph."]
    boxes = [(1, 0, 612.0, i, w, x0, x1, y, y) for i, (w, x0, x1, y) in enumerate([("wide", 100.0, 500.0, 0.0), ("left", 10.0, 40.0, 2.5), ("chained", 10.0, 40.0, 5.0), ("right", 400.0, 440.0, 0.0)])]
    words = spark.createDataFrame(boxes, "doc_id int, page_no int, page_width double, word_idx int, text string, x0 double, x1 double, top double, bottom double")
    assert [r.text for r in layout.words_to_lines(words).orderBy("line_no").collect()] == ["wide left chained", "right", ""]
    assert [r.text for r in layout.words_to_lines(words, "geometric").orderBy("line_no").collect()] == ["wide", "left chained", "right", ""]


def test_error_rate(spark):
    rows = spark.createDataFrame([(["A", "|", "B", "|"], ["A", "|", "C", "|"]), ([], []), (["A"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.coalesce(1).select(scoring.error_rate(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0, 1.0]


def test_audio(spark):
    rows = spark.createDataFrame([(24000, 1, 16, 100), (24000, 2, 16, 100)], "r int, c int, b int, m int")
    assert [r[0] for r in rows.coalesce(1).select(audio.silence_length(*map(F.col, "rcbm"))).collect()] == [4800, 9600]
    assert audio.parse_header(audio.write_header(1, 1, 24000, 16, 200) + bytes(200))[:6] == (1, 1, 24000, 16, 44, 200)
    assert audio.parse_header(audio.write_header(3, 1, 24000, 32, 200))[3] == 32
    assert audio.parse_header(b"no")[6]


def test_records(spark):
    log = spark.createDataFrame([("a", e) for e in ("start", "start", "complete", "start")] + [("b", "complete")], "pdf string, event string")
    assert records.strikes(log).collect() == [("a", 2)]
    good = spark.createDataFrame([(0, 3), (3, 0), (2, 1)], "g int, b int").coalesce(1)
    assert [r[0] for r in good.select(records.outcome(F.col("g"), F.col("b"))).collect()] == ["Picturebook", "Clean", "Part"]


SETTINGS = """[anything]
input = "book.txt"
out_dir = "out"
max_words = 90
sentence_gap_ms = 10
paragraph_gap_ms = 20
validate = true
validate_threshold = 0.18
crane_tts_voice = "Other"
"""


def test_config(tmp_path):
    c = parse([])
    assert (c.input, c.out_dir, c.rest_ms, c.min_chars, c.max_words, c.merge, c.to_mp3, c.sentence_gap_ms, c.paragraph_gap_ms, c.validate_threshold, c.llm_clean, c.mode) == ("text.txt", "audio_out", 500, 10, 200, True, False, 180, 360, 0.15, False, "default")
    assert parse(["--rip-pdf", "x.pdf"]).llm_clean and parse(["--batch-pdf", "d", "--merge-only"]).mode == "batch" and parse(["--fix-quarantine", "--merge-only"]).mode == "merge-only"
    c = parse(["-i", "a", "-o", "b", "--merge", "false", "--to-mp3", "true", "--skip-refs", "false", "--batch-pdf"])
    assert (c.input, c.out_dir, c.merge, c.to_mp3, c.skip_refs, c.batch_pdf) == ("a", "b", False, True, False, "batch")
    with pytest.raises(SystemExit):
        parse(["--merge", "maybe"])
    (tmp_path / "broken.toml").write_text("[anything\n")
    (tmp_path / "s.toml").write_text(SETTINGS)
    c = parse(["--max-words", "7"], str(tmp_path / "none"), str(tmp_path / "broken.toml"), str(tmp_path / "s.toml"))
    assert (c.input, c.out_dir, c.max_words, c.sentence_gap_ms, c.paragraph_gap_ms, c.validate, c.validate_threshold, c.crane_tts_voice) == ("book.txt", "out", 7, 10, 20, True, 0.18, "Other")
    (tmp_path / "s.toml").write_text('[anything]\nmax_words = "many"\n')
    with pytest.raises(TypeError):
        parse([], str(tmp_path / "s.toml"))


def test_replies_are_trimmed(spark):
    answers = {"a": "\n", "b": " new \n", "c": "<think>x</think>\u00a0", "d": "\tDROP ", "e": "old"}

    def load():
        def answer(x):
            if x == "f":
                raise OSError("gone")
            return answers[x]

        return answer

    rows = spark.createDataFrame([(2**53 + 1, x) for x in "abcdef"] + [(None, "a")], "doc_id long, text string").coalesce(1)
    got = {r.text: r for r in models.rewrite(rows, load).collect()}
    assert {t: r.cleaned for t, r in got.items()} == {"a": "a", "b": "new", "c": "c", "d": None, "e": "old", "f": "f"}
    assert got["f"].error == "OSError: gone" and {r.doc_id for r in models.rewrite(rows, load).collect()} == {2**53 + 1, None}


def test_ids_beside_nulls_stay_whole(spark):
    odd = 2**53 + 1
    docs = spark.createDataFrame([(odd, "A paragraph of words.\r\n\r\nAnother one of these."), (None, "A paragraph of words."), (3, None)], "doc_id long, text string").coalesce(1)
    for most in (0, 200):
        assert sorted((r.doc_id or 0, r.ordinal, r.trailing_boundary or "") for r in chunking.chunks(docs, 10, most).collect()) == [(0, 1, ""), (odd, 1, "Paragraph"), (odd, 2, "")]
    wavs = spark.createDataFrame([(odd, audio.write_header(1, 1, 24000, 16, 2) + b"ab"), (None, b"no"), (1, None)], "id long, content binary").coalesce(1)
    assert {(r.id, r.data_len) for r in audio.headers(wavs).collect()} == {(odd, 2), (None, None), (1, None)}


def test_attempts_ask_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def count(kind):
        (calls / f"{kind}-{uuid.uuid4()}").touch()

    def speaker():
        def say(text):
            count("say")
            if text.startswith("mute"):
                raise ValueError("no voice")
            return models.tone_speaker()(text)

        return say

    def reader():
        def hear(wav):
            count("hear")
            text = models.tone_reader()(wav)
            if text.startswith("deaf"):
                raise ValueError("no ears")
            return text if text.isascii() else ""

        return hear

    rows = spark.createDataFrame([(1, "the good one"), (2, "the — odd one"), (3, "mute one"), (4, "deaf to this"), (None, "the good one")], "id long, text string")
    tries = scoring.attempted(rows, lambda d: models.speak(d, speaker), lambda d: models.transcribe(d, reader), scoring.sample_lexicon(spark))
    got = {r.id: (r.attempts, r.status, r.error) for r in scoring.verdicts(tries).where("id IS NOT NULL").collect()}
    assert got == {1: (1, "Ok", None), 2: (2, "Ok", None), 3: (1, "Failed", "ValueError: no voice"), 4: (2, "Quarantined", None)}
    tries.count(), scoring.sidecars(tries).count()
    assert (len(list(calls.glob("say-*"))), len(list(calls.glob("hear-*")))) == (7, 6)
    report = scoring.sidecars(tries).where("report IS NOT NULL").collect()
    assert [r.report for r in report] == ["ORIGINAL:\ndeaf to this\n\nTRANSCRIPTION:\n\n\nPHONEME_ERROR: 1.0000\nATTEMPTS: 2\n"]


def test_letters_of_several_capitals_are_one_token(spark):
    rows = spark.createDataFrame([(["SS", "|"], ["S", "|"]), (["SS", "T"], ["SS", "T"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.coalesce(1).select(scoring.error_rate(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_merged_files_are_whole(spark):
    def wav(rate, body, tag=1):
        return audio.write_header(tag, 1, rate, 16, len(body)) + body

    rows = [(1, 2, wav(1000, b"cd"), None), (1, 1, b"RIFF\x00\x00\x00\x00WAVELIST\x03\x00\x00\x00abc\x00" + wav(1000, b"ab")[12:], "Sentence"), (2, 1, wav(1000, b"ab"), "Paragraph"), (2, 2, wav(2000, b"cd"), None), (3, 1, b"no", None), (None, 1, wav(1000, b"xy", 3), None)]
    got = {r.doc_id: r for r in audio.merge(spark.createDataFrame(rows, "doc_id long, ordinal int, content binary, trailing_boundary string")).collect()}
    assert bytes(got[1].content) == audio.write_header(1, 1, 1000, 16, 4 + 360) + b"ab" + bytes(360) + b"cd"
    assert (got[2].content, got[2].error, got[3].error) == (None, "formats differ", "not a WAV file") and bytes(got[None].content) == wav(1000, b"xy", 3)
    made = models.mapped(spark.createDataFrame([(1, bytearray(b"abc"))], "id int, content binary"), models.command(["cat"]), "content", "mp3", "binary").first()
    assert bytes(made.mp3) == b"abc" and models.mapped(spark.createDataFrame([(1, bytearray(b"abc"))], "id int, content binary"), models.command(["false"]), "content", "mp3", "binary").first().mp3 is None


def test_files(spark, tmp_path):
    runs = spark.createDataFrame([("t", "a", None, None, [(1, "w", None, ("Ok", None, None))])], records.RUN)
    path = str(tmp_path / "runs")
    for _ in range(2):
        files.write_run_records(runs, path)
    back = files.run_records(spark, path)
    files.write_run_records(back.union(back), path)  # reads what it replaces
    assert files.run_records(spark, path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["runs"]
    assert records.chunk_records(files.run_records(spark, path)).first().wav == "w"
    assert files.export_files(spark.createDataFrame([("x.bin", bytearray(b"\x00\xff"))], "name string, content binary"), str(tmp_path / "out")) == 1
    assert (tmp_path / "out" / "x.bin").read_bytes() == b"\x00\xff"
    (tmp_path / "p.PDF").write_bytes(b"one two")
    words = files.pdf_words(spark, str(tmp_path), lambda: lambda data: [(1, 600.0, k, w.decode(), 10.0 + k, 11.0 + k, 5.0, 6.0) for k, w in enumerate(data.split())])
    assert [r.text for r in layout.words_to_lines(words).orderBy("line_no").collect()] == ["one two", ""]


def test_runs_repair_and_merge(spark):
    def deaf():
        return lambda wav: (t := models.tone_reader()(wav))[: len(t) if t.isascii() else 0]

    docs = spark.createDataFrame([("d", "A first paragraph.\n\nA second — paragraph.\n\nThe third “paragraph” é.")], "doc_id string, text string")
    cfg = Config(validate=True, validate_threshold=-1.0)  # nothing passes
    steps = drivers.Steps(speak=models.tone_speaker, transcribe=deaf, lexicon=scoring.sample_lexicon(spark))
    run = drivers.default_run(docs, steps, cfg)
    assert [r.status.status for r in run.chunks.collect()] == ["Quarantined"] * 3 and run.merged.count() == 0 and not drivers.failed(run)
    cfg = Config(validate=True)
    fixed, sound = drivers.fix_quarantine(run.chunks.drop("audio"), steps, cfg)
    assert [r.status.status for r in fixed.orderBy("ordinal").collect()] == ["Ok"] * 3
    whole, missing = drivers.merge_only(fixed, sound.where("ordinal < 3").select("input_file", "wav", F.col("audio").alias("content")), cfg)
    assert [r.ordinal for r in missing.collect()] == [3]
    # spoken from the sanitised text, which has no dash; the second ends a paragraph too, so a gap follows it
    assert len(whole.first().content) == 44 + 2 * len("A first paragraph.A second paragraph.") + 2 * 2 * 24 * 360
    runs = records.run_of(fixed, run.texts.select(F.col("doc_id").alias("input_file"), F.lit(None).cast("string").alias("pdf_ripped"), "llm_clean")).first()
    assert [c.ordinal for c in runs.chunks] == [1, 2, 3]


def test_lengths_saturate(spark):
    plan = spark.createDataFrame([(1, 3_000_000_000, 0), (1, 2_000_000_000, 0), (2, 40, 8)], "doc_id int, data_len long, gap_len long").selectExpr("*", "24000 AS sample_rate", "1 AS channels", "16 AS bits_per_sample")
    assert {r.doc_id: (r.data_len, r.seconds) for r in audio.merged_length(plan).collect()} == {1: (4294967295, 4294967295 / 48000), 2: (48, 0.001)}
    rows = spark.createDataFrame([(tag, c, rate, bits, n) for tag, c, rate, bits in ((1, 2, 44100, 16), (3, 1, 8000, 32)) for n in (0, 7, 4294967290, 4294967295, 10**10)], "t int, c int, r long, b int, n long").coalesce(1)
    made = rows.select("*", audio.header_bytes(*map(F.col, "tcrbn")).alias("h")).collect()
    assert all(bytes(r.h) == audio.write_header(r.t, r.c, r.r, r.b, r.n) for r in made)


def test_every_glyph_by_hand(spark):
    want = {"[endash]": "-", "[emdash]": "—", "[quotedblleft]": "“", "[quotedblright]": "”", "[quoteleft]": "'", "[quoteright]": "'", "[fi]": "fi", "[fl]": "fl", "[ff]": "ff", "[ffi]": "ffi", "[ffl]": "ffl", "[ft]": "ft", "[st]": "st", "[bracketleft]": "[", "[bracketright]": "]", "[parenleft]": "(", "[parenright]": ")"}
    assert column(spark, T.glyphs_scrubbed, *[f"a{g}b" for g in want]) == [f"a{x}b" for x in want.values()]
    assert column(spark, T.glyphs_scrubbed, *[f"a[{g}]b" for g in ("bullet", "dagger", "daggerdbl", "section", "paragraph")]) == ["ab"] * 5


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [plan.count(x) for x in ("Exchange", "Window", "Sort ")]


def test_layout_gathers_words_before_its_only_exchange(spark):
    schema = "doc_id int, page_no int, page_width double, word_idx int, text string, x0 double, x1 double, top double, bottom double"
    # no page number: one page; no height: a line of its own, foremost; no text: nothing between spaces; a line feed in a word
    rows = [(1, None, 100.0, 0, "b", 10.0, 20.0, 0.0, 8.0), (1, None, 100.0, 1, None, 30.0, 40.0, 0.0, 8.0), (1, None, 100.0, 2, "c\nd", 40.0, 45.0, 2.0, 8.0), (1, None, 100.0, 3, "a", 10.0, 20.0, None, 8.0)]
    rows += [(1, 2, 100.0, 0, "right", 80.0, 90.0, 0.0, 8.0), (1, 2, 100.0, 1, "left", 10.0, 20.0, 50.0, 58.0), (None, 1, 100.0, 0, "none", 10.0, 20.0, 0.0, 8.0), (None, 1, 100.0, 1, "low", 10.0, 20.0, float("nan"), 8.0)]
    words = spark.createDataFrame(rows, schema).repartition(3)
    lines = layout.words_to_lines(words)
    got = [tuple(r) for r in lines.orderBy("doc_id", "line_no").collect()]
    assert got == [(None, 1, 1, "none"), (None, 1, 2, "low"), (None, 1, 3, ""), (1, None, 1, "a"), (1, None, 2, "b c\nd"), (1, None, 3, ""), (1, 2, 4, "left"), (1, 2, 5, "right"), (1, 2, 6, "")]
    plain = spark.createDataFrame(rows, schema).coalesce(1)
    for made in (layout.words_to_lines(plain), layout.words_to_lines(plain, "geometric"), layout.rip(plain)):
        made.collect()
        assert exchanges(made)[1:] == [0, 0]


def test_white_space_is_unicodes(spark):
    each = [chr(k) for k in range(1, 0x3100)]
    was = column(spark, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), *[c + "x " + c for c in each])
    assert column(spark, T.trimmed, *[c + "x " + c for c in each]) == was


def test_merge_exchanges_no_silence(spark):
    body = bytes(range(256)) * 2
    made = lambda n: audio.write_header(1, 1, 24000, 16, n) + body[:n]
    rows = [(1, 2, made(512), None), (1, 1, made(2), "Paragraph"), (1, None, made(4), "Sentence")]
    merged = audio.merge(spark.createDataFrame(rows, "doc_id long, ordinal int, content binary, trailing_boundary string"))
    data = body[:4] + bytes(24 * 180 * 2) + body[:2] + bytes(24 * 360 * 2) + body
    assert bytes(merged.first().content) == audio.write_header(1, 1, 24000, 16, len(data)) + data
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(" in plan and "repeat(" not in plan[plan.index("Aggregate") :]


def test_runs_join_no_speech(spark):
    docs = spark.createDataFrame([(1, "One is here.\n\nTwo is here too."), (None, "Three is without an id.")], "doc_id long, text string")
    cfg = Config(llm_clean=False, validate=False, max_words=0)
    run = drivers.default_run(docs, drivers.Steps(speak=models.tone_speaker), cfg)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(run.merged)
    assert [tuple(r) for r in run.chunks.orderBy("input_file", "ordinal").select("input_file", "ordinal", "trailing_boundary", "status.status").collect()] == [(None, 1, None, "Ok"), (1, 1, "Paragraph", "Ok"), (1, 2, None, "Ok")]
    files = run.chunks.where("ordinal = 1").select("input_file", "wav", F.col("audio").alias("content"))
    again, missing = drivers.merge_only(run.chunks.drop("audio"), files, cfg)
    assert plan(again).count("Join") == 1
    got = {r.doc_id: bytes(r.content)[44:] for r in again.collect()}
    assert got == {1: "One is here.".encode("utf-16-le") + bytes(24 * 360 * 2)}
    assert [(r.input_file, r.ordinal) for r in missing.where("input_file IS NOT NULL").collect()] == [(1, 2)]
