"""Operators beside plain versions of the same thing: spans by Python's re, splits by trial, quotas and targets by hand, whole queries by pairs."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ann, decontaminate, mixing, pii, secrets, tokens, toxicity, urls, warc

WORDS = ["lorem", "token", "pass", "word", "secret", "api", "key", "AKIA", "ghp_", "eyJ", "://", "sk_", "live_", "xox", "AIza", "é", "漢字", "\n", "\t", ":", "=", '"', "'", "0123456789abcdef", "abcdef012345", "Q7Z9", "-----BEGIN", "PRIVATE KEY-----", ".", "@", "+1", "10.0.0.1", "256.1.1.1", "4111 1111 1111 1111", "(212)", "555-0100", "a.b@c.org", "_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return {i: "".join(rng.choice(WORDS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 40))) for i in range(n)}


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)


SECRETS = {"assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6), "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 20), "hex": (re.compile("([0-9a-f]+)"), 24)}


def test_secret_spans_are_those_of_the_plain_scan(spark):
    texts = random_texts(800, 1)
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(table(spark, texts))).collect()}
    for i, t in texts.items():
        for k, (regex, least) in SECRETS.items():
            want = [f"{k}:{m.start()}:{m.end()}" for m in regex.finditer(t) if len(m[1]) >= least]
            assert [x for x in got[i].spans.split(",") if x.startswith(k + ":")] == want, (t, k)


def holds(q, text):
    return True if q is None else q[1] in text if q[0] == "tri" else (all if q[0] == "and" else any)(holds(x, text) for x in q[1])


def test_candidates_are_the_texts_that_satisfy_the_queries(spark):
    texts = random_texts(600, 2) | {1000: "password = hunter22", 1001: "password = hunter22"}  # equal texts share a key
    docs = table(spark, texts)
    met = {r.key: r.rules for r in secrets.candidates(secrets.postings(docs)).collect()}
    keys = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64("text").alias("key")).collect()}
    for k, rule in enumerate(secrets.RULES):
        q = secrets.trigram_query(rule.regex)
        if q is not None:
            assert {i for i in texts if met.get(keys[i], 0) >> k & 1} == {i for i, t in texts.items() if holds(q, t.lower())}, rule.kind
            assert all(holds(q, t.lower()) for t in texts.values() if re.search(rule.regex, t)), rule.kind


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (re.compile(r"[0-9](?:[\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_spans_are_those_of_the_plain_scan(spark):
    texts = random_texts(800, 3)
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(table(spark, texts))).collect()}
    for i, t in texts.items():
        for k, (regex, passes) in PII.items():
            want = [f"{k}:{m.start()}:{m.end()}" for m in regex.finditer(t) if passes(m[0])]
            assert [x for x in got[i].split(",") if x.startswith(k + ":")] == want, (t, k)


def test_contexts_find_what_they_should_and_little_else(spark):
    rng = random.Random(4)
    filler = ["lorem", "ipsum", "dolor", "page", "amet", "figure"]
    texts = {}
    for i in range(400):
        body = " ".join(rng.choice(filler) for _ in range(20))
        number = rng.choice(["3", "12", "1999", "a1"])  # numbers that are nobody's
        texts[i] = f"{body} page {number} {body}"
        if i % 4 == 0:
            texts[i] += f" contact u{i}@mail.org"
        if i % 40 == 1:
            texts[i] += f" contact u{i}-at-mail.org7"
    got = {r.doc_id: r.n_context for r in pii.digest(pii.find_pii(table(spark, texts))).collect()}
    planted = {i for i in texts if i % 40 == 1}
    assert {i for i, n in got.items() if n} == planted


def test_whole_leaks_by_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(3, 8)))
    items = {k: " ".join(word() for _ in range(30)) for k in range(6)}
    texts = {}
    for i in range(60):
        body = [word() for _ in range(40)]
        if i % 3 == 0:
            own = items[i % 6].split()
            kept = [w if rng.random() > 0.04 else w[:-1] + "x" for w in own]
            body[10:10] = kept
        texts[i] = " ".join(body)

    def least(p, t):
        c = np.zeros(len(t) + 1, int)
        for i, a in enumerate(p, 1):
            n = np.minimum(c[:-1] + np.array([a != b for b in t]), c[1:] + 1)
            n = np.r_[i, n]
            c = np.minimum.accumulate(n - np.arange(len(n))) + np.arange(len(n))
        return int(c.min())

    want = {(i, k) for i, t in texts.items() for k, item in items.items() if any(least(p, t) <= int(0.1 * len(p)) for p in set(decontaminate.pieces_of(item)))}
    bench = spark.createDataFrame([(f"item {k}", t) for k, t in items.items()], "item_id string, text string")
    got = {(r.id, int(r.item_id[5:])) for r in decontaminate.find_leaks(table(spark, texts), bench, block=4).collect()}
    assert want <= got and {k for _, k in want} == {0, 3}
    # beyond the pieces end to end only those that begin elsewhere can add
    assert all(any(least(p, texts[i]) <= int(0.1 * len(p)) for _, p in decontaminate.overlapping(items[k])) for i, k in got - want)


def test_leaks_in_any_letters(spark):
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("абвгдежзиклмнопрст漢字語") for _ in range(6)) for _ in range(30))
    edited = list(item)
    for k in range(5, len(item), 25):
        edited[k] = "я"  # one edit a character, however many bytes it has
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find_leaks(table(spark, {1: "x " + "".join(edited) + " y", 2: "другой текст " * 20}), bench).collect()
    assert {r.id for r in got} == {1}


def all_splits(name):
    for cuts in range(2 ** (len(name) - 1)):
        ends = [k + 1 for k in range(len(name) - 1) if cuts >> k & 1] + [len(name)]
        yield [name[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_split_is_the_best_of_all_splits():
    rng = random.Random(7)
    for _ in range(60):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        total = sum(counts.values()) + 1
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        price = lambda ws: sum(math.log(counts[w] / total) if w in counts else math.log(1 / total) - 2 * len(w) for w in ws)  # noqa: E731, B023
        assert abs(price(urls.split(name, counts, total)) - max(map(price, all_splits(name)))) < 1e-9


def test_verdicts_by_hand_counts(spark):
    rng = random.Random(8)
    hosts = ["cheappills", "goodbooks", "pillshop", "bookshop", "cheapbooks"]
    made = [f"http://{rng.choice(hosts)}.{rng.choice(['com', 'net', 'org', 'edu'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(0, 12)}" for _ in range(300)] + [None, "none", "http://" + "a" * 3000 + ".edu/", "http://x.edu/"]
    made += made[:20]  # ties and repeated rows
    pages = spark.createDataFrame([(i if i % 50 else None, u, "<b>cheap pills</b> good books shop " * (i % 3)) for i, u in enumerate(made)], "page_id long, url string, html string").repartition(4)
    got = urls.judge(pages).collect()
    assert len(got) == len(made)
    counts = {}
    for i, u in enumerate(made):
        for w in re.findall(r"(?<![^\W\d_])[^\W\d_]+", ((" cheap pills  good books shop " * (i % 3)) + " " + (u or "")).lower()):
            if len(w) <= urls.LONGEST:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) + 1
    by = {(r.host, r.path): r for r in got}
    tokens_of = lambda r: [m + w for _, m, run, letters in urls.runs(r.host, r.path) for w in (urls.split(run, counts, total) if letters else [run])]
    sums, urls_by = {}, {"block": 0, "allow": 0}
    for r in got:
        assert r.words == " ".join(tokens_of(r))
        if r.rule is not None:
            urls_by[r.verdict] += 1
            for t in tokens_of(r):
                sums.setdefault(t, {"block": 0, "allow": 0})[r.verdict] += 1
    size = {v: sum(s[v] for s in sums.values()) + len(sums) + 1 for v in urls_by}
    for r in by.values():
        margin = math.log((urls_by["block"] + 1) / (urls_by["allow"] + 1)) + sum(math.log((sums[t]["block"] + 1) / size["block"]) - math.log((sums[t]["allow"] + 1) / size["allow"]) for t in tokens_of(r) if t in sums)
        assert abs(r.margin - margin) < 1e-9 and (r.rule is not None or r.verdict == ("block" if margin > 0 else "allow"))
    assert len({r.verdict for r in by.values() if r.rule is None}) == 2


def test_targets_by_hand(spark):
    rng = random.Random(9)
    for _ in range(4):
        sizes = {rng.choice("abcdefgh") + str(k): rng.choice([0, 1, 10, 100, 5000]) for k in range(rng.randint(1, 7))}
        want = dict.fromkeys(sizes, 0.0)
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        left, free = float(sum(sizes.values())), set(sizes)
        while free:  # pour by weight, stop whoever is over, pour the rest again
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if level * weight[s] > 3 * sizes[s]}
            for s in over or free:
                want[s] = 3.0 * sizes[s] if over else level * weight[s]
            left -= sum(want[s] for s in over)
            free -= over or free
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes), (sizes, got, want)


def test_shards_hold_the_draws_and_each_draw_once(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice("abc")) for i in range(900)] + [(7, "same text", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, shards=5)
    draws = [d for r in mixing.digest(mixed).collect() for d in r.shards.split(",") if d]
    one = mixing.digest(mixed).agg(F.sum("draws")).first()[0]
    assert len(draws) == one and set(draws) == set("01234")
    again = mixing.digest(mixing.mix(docs.repartition(7), shards=5))
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.digest(mixed).collect()))  # however rows are dealt


def test_features_by_hand():
    mined = {"grob": 2.0, "blod*": 1.5}
    text = "You STUPID grob!!  blodest b4d loooser x y z $ you"
    f = dict(zip(toxicity.NAMES, toxicity.features(text, toxicity.Mined(mined)), strict=True))
    words = toxicity.tokens(text)
    n = len(words)
    assert words[:4] == ["you", "stupid", "grob", "blodest"]
    assert f["lexicon"] == 1 / n and f["mined"] == 1 / n and f["mined_weight"] == 2.0 and f["stems"] == 1 / n and f["stem_weight"] == 1.5 / n
    assert f["second"] == 2 / n and f["near_second"] == sum(abs(i - j) <= 5 for i, a in enumerate(words) for j, b in enumerate(words) if a in ("stupid", "grob") and b == "you") / n
    assert f["exclaim"] == 2 / n and f["shouted"] == 1 / n and f["digits_inside"] == 1 / n and f["held"] == 1 / n and f["spaced"] == 1 / n


def test_trees_split_where_trial_does():
    from scriptorium.llm import boosting

    rng = np.random.default_rng(11)
    x = rng.integers(0, 10, (200, 2)).astype(float)
    y = (x[:, 1] >= 6).astype(float)
    margin = boosting.Trees().fit(x, y).margin(x)
    assert margin[y == 1].min() > 0 > margin[y == 0].max()
    best = max(((abs(y[x[:, c] >= v].mean() - y[x[:, c] < v].mean()) if 0 < (x[:, c] >= v).sum() < 200 else 0), c, v) for c in (0, 1) for v in range(10))
    assert best[1:] == (1, 6)


def test_neighbours_by_default_reach_the_recall_and_verify_a_part(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 48))
    x = np.repeat(centres, 75, axis=0) + 0.5 * rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = rng.permutation(x)
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, cell=300).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    hits = 0
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -score))[:20].tolist())
        hits += len(best & {i for i, _ in got[q].values()})
        assert all(abs(s - score[i]) < 1e-12 for i, s in got[q].values()) and sorted(got[q]) == list(range(1, 21))
    assert hits / (150 * 20) >= 0.9
    *_, verified = ann.search(x, x[::20], np.full(150, -np.inf), 21, 1.0)
    assert verified < 0.5 * 150 * 3000


def test_upper_tree_gives_each_point_its_own_leaf():
    rng = np.random.default_rng(13)
    points = np.r_[rng.standard_normal((500, 3)), np.repeat(rng.standard_normal((2, 3)), 300, axis=0)]
    tree = ann.Tree(points, 40)
    home = tree.leaves(points)
    for k, members in enumerate(tree.members):
        assert (home[members] == k).all()
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(len(points)))


def test_pages_of_any_bytes_survive(spark, tmp_path):
    gif = b"GIF89a\x01\x00\xff\xfe\x00\x80" + bytes(range(256)) + b"\r\n\r\nHTTP/1.1\x00"
    big = random.Random(14).randbytes(1 << 17)
    rows = [(9, "http://a/gif", gif), (3, "filedesc://looks/like/a/version/block", gif), (5, "http://²/x ²", b"1 0 x\n"), (2**53 + 1, "http://big", big), (None, "http://null", gif), (4, None, None), (2**53 + 3, "http://big2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").repartition(3)
    warc.convert(pages, str(tmp_path / "w"))
    back = {r.key: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert set(back) == {"9", "3", "5", str(2**53 + 1), None, "4", str(2**53 + 3)}
    assert (back["3"].type, back["9"].type, back["9"].refers, back["9"].refers_to) == ("response", "revisit", "3", back["3"].record)
    assert bytes(back["3"].payload) == gif and bytes(back[str(2**53 + 1)].payload) == big and back[str(2**53 + 3)].refers == str(2**53 + 1)
    assert back["5"].url == "http://²/x ²" and back["3"].url.startswith("filedesc:") and all(r.sound in (True, None) for r in back.values())
    import gzip

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").rglob("part-*") if p.stat().st_size)  # any gzip reader can
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    assert list(warc.members(gzip.compress(b"a") + gzip.compress(b"") + gzip.compress(b"b" * 200_000))) == [b"a", b"b" * 200_000]
    assert warc.member(bytes(1 << 24))[-1:] != b"" and gzip.decompress(warc.member(bytes(1 << 24)) + b"\0") == bytes(1 << 24)


def test_ids_beside_nulls_stay_whole(spark):
    odd = 2**53 + 1
    item = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(odd, item), (None, item), (None, None)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(odd + 2, item)], "item_id long, text string")
    assert {r.id for r in toxicity.toxicity(docs, labels).collect()} == {odd, None}
    assert {(r.id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(odd, odd + 2), (None, odd + 2)}
    pages = docs.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert {r.id for r in urls.judge(pages).collect()} == {odd, None}


def byte_pieces(w, score, single, unknown):
    """Least-cost pieces of w by trial of every cut; of equal scores the last piece that starts first."""
    best = {0: (0.0, 0)}
    for e in range(1, len(w) + 1):
        options = []
        for s in range(e):
            if w[s:e] in score:
                options.append((best[s][0] + score[w[s:e]], -s, best[s][1] + 1))
        if w[e - 1] not in single:
            options.append((best[e - 1][0] + unknown, -(e - 1), best[e - 1][1] + len(w[e - 1].encode())))
        top = max(o[0] for o in options)
        best[e] = max((o for o in options if o[0] == top), key=lambda o: o[1])[::2]
    return best[len(w)][1]


def test_byte_pieces_count_as_by_trial():
    rng = random.Random(15)
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.0, "▁a": -2.0, "aba": -4.5}
    counter = tokens.Counter(list(pieces.items()), True)
    for _ in range(300):
        w = tokens.MARK + "".join(rng.choice("abé漢") for _ in range(rng.randint(1, 12)))
        assert counter.word(w) == byte_pieces(w, pieces, counter.single, counter.unknown), w


@pytest.mark.parametrize("copies", [40, 160])
def test_near_misses_make_few_candidates(spark, copies):
    """A group of which every two members share most of their text but too little: the last join makes rows in proportion."""
    from scriptorium.llm import minhash
    from scriptorium.llm.common import Scratch

    common = " ".join(f"c{k}" for k in range(140))
    texts = {i: common + " " + " ".join(f"u{i}_{k}" for k in range(70)) for i in range(copies)}
    docs = table(spark, texts)
    got = minhash.near_duplicates(docs).collect()
    assert all(r.component_id == r.id for r in got)
    cut = Scratch(spark)
    rare = minhash.rare_shingles(docs.select(F.col("doc_id").alias("id"), F.lit(True).alias("outer")), docs, "doc_id", "text", 75, cut).collect()
    assert len(rare) <= copies  # each has 70 and more of its own before any that others hold
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in texts.items()}
    assert max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(5), 2)) > 0.45


def test_pipeline_end_to_end(spark, tmp_path):
    """All stages over a small table, beside what each must do by hand."""
    import corpus_pipeline

    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8)))
    item = " ".join(word() for _ in range(40))
    texts, toxic = {}, {i for i in range(600) if i % 5 == 1}
    for i in range(600):
        body = [word() for _ in range(60)]
        if i in toxic:
            body[10:10] = ["you", "stupid", "idiot", "worthless", "scum", "loser"]
        texts[i] = " ".join(body)
    for i in range(0, 600, 50):
        texts[i + 3] = texts[i + 2]  # an exact copy
        texts[i + 4] = texts[i + 2].rsplit(" ", 2)[0] + " other end"  # a near one
        texts[i + 7] = texts[i + 7] + " " + item
        texts[i + 8] += " token=abcdefgh99"
    source = {i: "abc"[i % 3] for i in texts}
    rows = [(i, t, "en", source[i], len(t)) for i, t in texts.items()] + [(700, None, "en", None, 0), (701, "", "en", "a", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    gone = toxic | {i + k for i in range(0, 600, 50) for k in (3, 4, 7)}
    kept = set(texts) - gone
    assert set(out) <= kept | {700, 701} and len(out) > len(kept) / 3  # those without words may be drawn with their block
    out = {i: r for i, r in out.items() if i < 700}
    for i, r in out.items():
        assert r.text == texts[i].replace("token=abcdefgh99", "[SECRET]") and r.n_chars == len(r.text) and len(r.draws) >= 1
    sizes = {s: sum(len(texts[i].replace("token=abcdefgh99", "[SECRET]").split()) for i in kept if source[i] == s) for s in "abc"}
    targets = {s: w * sum(sizes.values()) / 8 for s, w in zip("abc", (5, 2, 1), strict=True)}
    for s in "abc":
        assert abs(sum(r.size * len(r.draws) for r in out.values() if r.source == s) - min(targets[s], 3 * sizes[s])) <= 80


def test_first_by_hash_is_the_same_however_rows_are_dealt(spark):
    from scriptorium.llm.common import first_by_hash

    rows = spark.range(5000).withColumn("v", F.col("id") % 7)
    got = [sorted(r.id for r in first_by_hash(rows.repartition(k), 100, "id", "v").collect()) for k in (1, 9)]
    order = [r.id for r in rows.orderBy(F.shiftrightunsigned(F.xxhash64("id", "v"), 32), "id", "v").limit(100).collect()]
    assert got[0] == got[1] == sorted(order) and first_by_hash(rows, 6000, "id").count() == 5000 and first_by_hash(rows.limit(0), 5, "id").count() == 0


def test_repeated_rows_and_partitions_change_nothing(spark):
    """Each row of a table that stands twice, dealt otherwise, has the result that it has alone."""
    from collections import Counter

    from scriptorium.llm import minhash
    from scriptorium.llm.queries import VOCABULARY

    texts = random_texts(150, 17)
    item = " ".join(f"word{k}" for k in range(30))
    texts |= {200 + k: f"before {item} after {k}" for k in range(3)} | {300: None, 301: "", 302: item * 50}
    docs = table(spark, texts)
    twice = docs.unionAll(docs).repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for f in (
        lambda d: secrets.digest(secrets.find_secrets(d)),
        lambda d: pii.digest(pii.find_pii(d)),
        lambda d: decontaminate.find_leaks(d, bench),
        lambda d: tokens.count_tokens(d, VOCABULARY),
        lambda d: toxicity.toxicity(d, labels),
    ):
        assert Counter(map(str, f(twice).collect())) == Counter(2 * list(map(str, f(docs).collect())))
    near = lambda d: sorted(map(str, minhash.near_duplicates(d).collect()))
    assert near(twice) == near(docs)


def test_mixing_holds_a_very_long_document(spark):
    rows = [(i, "w " * (50_000 if i == 5 else 20), "a" if i % 2 else None) for i in range(200)]
    mixed = mixing.digest(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    by = {}
    for r in mixed:
        assert r.taken <= 3 * r.size and r.taken == r.size * r.draws
        by.setdefault(r.target, []).append(r.taken)
    long = next(r.target for r in mixed if r.doc_id == 5)
    assert all(abs(sum(v) - t) <= (50_000 if t == long else 20) for t, v in by.items())
