import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chunks, mixture, packing, spam, tokens
from tessera.llm.chunks import Limits, cut, split_texts

# ---- pieces


def checked(text, limits):
    pieces = cut(text, limits)
    joined, before = "", None
    for start, stop in pieces:
        assert stop - start <= limits.size and (stop > start or not text)
        if before is not None:
            assert before - limits.overlap <= start <= before < stop
            joined += text[before:stop]
        else:
            joined += text[start:stop]
        before = stop
    assert joined == text
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "Longer. ", "\n", "\n\n", " ", "é。", "x" * 40, "! "]), max_size=300).map("".join))
def test_pieces_make_up_the_text(text):
    checked(text, Limits(size=100, overlap=10))


def test_cuts_at_boundaries():
    text = " ".join(f"Sentence number {i} speaks of {'cats and dogs' if i < 30 else 'ships and tides'}." for i in range(60))
    limits = Limits(size=600, overlap=60)
    for start, stop in checked(text, limits)[:-1]:
        assert text[stop - 1] == " " and text[stop - 2] == "."
        assert start == 0 or text[start - 1] == " "
    # a topic ends where the words change
    deep = chunks.depths(text, chunks.boundaries(text), 3)
    assert 28 <= deep.index(max(deep)) <= 30


def test_no_boundaries():
    pieces = checked("x" * 5000, Limits())
    assert pieces[0] == (0, 1200) and pieces[1][0] == 1080


def test_japanese_is_cut_between_topics():
    cats = [f"{w}猫は庭で魚を食べる。" for w in "昨今毎明先"]
    market = [f"{w}株価が市場で下落した。" for w in "昨今毎明先"]
    text = "".join(cats + market)
    turn = len("".join(cats))
    cuts = chunks.boundaries(text)
    depth = chunks.depths(text, cuts, 3)
    assert cuts[max(range(len(cuts)), key=depth.__getitem__)] == turn
    assert cut(text, Limits(size=len(text) - 1, overlap=0, least=0.2))[0] == (0, turn)
    assert chunks.words("カメラ2台と lens、猫") == ["カメ", "メラ", "2", "台と", "lens", "猫"]


def test_split_texts_odd_rows(spark):
    long = "Some words here. " * 20_000
    rows = [(1, None), (2, ""), (3, "short"), (None, "short"), (3, "short"), (4, "y" * 1200), (5, "y" * 1201), (6, long)]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("id", "t", "1 as piece", "'x' as text", "2 as start")
    out = split_texts(df, "id", "t").collect()
    n = {i: sum(r.id == i for r in out) for i in (1, 2, 3, None, 4, 5)}
    assert n == {1: 0, 2: 1, 3: 2, None: 1, 4: 1, 5: 2}
    mine = sorted((r for r in out if r.id == 6), key=lambda r: r.piece)
    assert "".join(r.text[r.overlap :] for r in mine) == long
    assert split_texts(df, "id", "t", only_oversized=True).select("id").distinct().count() == 2
    assert split_texts(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "t", Limits(size=100, overlap=60))


# ---- containers


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=200))
def test_packing_fits(sizes):
    sizes = np.array(sizes, np.int64)
    place, capacity = packing.pack(sizes, (512, 1024, 2048, 4096))
    content = np.bincount(place, weights=sizes, minlength=len(capacity)) if len(sizes) else np.zeros(0)
    assert len(place) == len(sizes) and (content <= capacity).all() and (content > 0).all()
    assert len(capacity) <= max(1, len(sizes))


def test_best_fit_is_tight():
    r = random.Random(5)
    sizes = np.array([r.randint(20, 900) for _ in range(3000)])
    _, capacity = packing.pack(sizes, (512, 1024, 2048, 4096))
    assert sizes.sum() / capacity.sum() > 0.99


def test_each_opening_chooses_its_size():
    """Pairs that fill 512 and triples that fill 1,024 exactly: no single size to open fits both."""
    sizes = np.array([500] * 20 + [12] * 20 + [900] * 10 + [100] * 10 + [24] * 10, np.int64)
    bins, content = packing.best_fit(np.sort(sizes)[::-1].tolist(), (512, 1024, 2048, 4096), None)
    cut = np.array((512, 1024, 2048, 4096))[np.searchsorted((512, 1024, 2048, 4096), content)]
    assert cut.sum() == sizes.sum() and len(bins) == len(sizes)
    left = packing.Left([5, 5, 3])
    assert (left.fill(10), left.fill(9), left.fill(2), left.fill(20)) == (10, 8, 0, 13)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_filling_is_near_the_bound(spark):
    from tessera.llm import queries

    whole = next(r for r in queries.p7_filling(spark, "/root/testdata/sf0.01").collect() if r.capacity is None)
    assert whole.unused_share < 0.02
    placed = queries.p7_placed(spark, "/root/testdata/sf0.01").agg({"n_tokens": "sum"}).first()[0]
    assert whole.n_tokens == placed and whole.least_bins == -(-placed // 4096)


def test_pack_texts(spark):
    rows = [(1, None), (2, ""), (3, "a few words"), (3, "a few words"), (None, "no id"), (4, "word " * 9000), (5, " ")] + [(i, "some words " * (i % 300)) for i in range(10, 200)]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("id", "t", "7 as bin", "8 as at", "9 as capacity").repartition(3)
    out = packing.pack_texts(df, "id", "t").collect()
    encode = tokens.encoder().encode_ordinary
    assert sum(r.n_tokens for r in out) == sum(len(encode(t or "")) for _, t in rows)
    assert all((r.bin is None) == (r.n_tokens == 0) for r in out)
    assert sorted(r.piece for r in out if r.id == 4) == [0, 1, 2] and {r.n_pieces for r in out if r.id == 4} == {3}
    assert all(r.n_pieces == 1 for r in out if r.id != 4)
    bins = {}
    for r in out:
        if r.bin is not None:
            bins.setdefault((r.bin, r.capacity), []).append((r.at, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), items in bins.items():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= capacity
    assert packing.pack_texts(df.limit(0), "id", "t").count() == 0


# ---- mixture


def sources(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixture(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(1, 60), s) for i, s in enumerate(["big"] * 600 + ["Mid-Size "] * 200 + ["tiny"] * 20 + ["other"] * 50)]
    rows += [(10_000, None, "big"), (10_001, "", "tiny"), (10_002, "word " * 30, None), (None, "word", "big"), (5, "word again", "big")]
    docs = spark.createDataFrame(rows, "id bigint, t string, s string").selectExpr("id", "t", "s", "1 as source", "2 as copies", "3 as split").repartition(5)
    m = mixture.mix(docs, "id", "t", "s", sources(spark, [("big", 0.4, 1), ("mid_size", 0.3, 3), ("tiny", 0.2, 2), ("none", 0.1, 4)]))
    report = {x.source: x for x in m.report.collect()}
    assert report["tiny"].short and report["none"].short and not report["big"].short
    assert report["none"].mixed_tokens == 0 and abs(sum(x.actual_share for x in report.values()) - 1) < 1e-9
    most = {"big": 1, "mid_size": 3, "tiny": 2}
    uses = m.copies.groupBy("source").agg({"copies": "max"}).collect()
    assert all(x["max(copies)"] <= most[x.source] for x in uses)
    # a source is used as often as its rate says, to one document
    n = {"big": 602, "mid_size": 200, "tiny": 20}
    for x in m.copies.groupBy("source").agg({"copies": "sum"}).collect():
        assert abs(x["sum(copies)"] - report[x.source].rate * n[x.source]) <= 1
    assert m.rows().count() == sum(x.copies for x in m.copies.collect())
    big = report["big"]
    assert abs(big.mixed_tokens / (big.target_share * sum(len(tokens.encoder().encode_ordinary(t or "")) for _, t, _ in rows)) - 1) < 0.03


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_all_targets_hold_within_reach(spark):
    from tessera.llm import queries

    report = queries.p8_reachable(spark, "/root/testdata/sf0.1").collect()
    assert all(abs(r.missed) < 0.01 for r in report) and any(r.short for r in report)
    assert {r.offset for r in report} == {random.Random(42).random()} and all(r.wanted_total == pytest.approx(r.reachable_total) for r in report)
    full = queries.p8_report(spark, "/root/testdata/sf0.1").collect()
    assert all(r.missed > 0 for r in full if r.short) and all(r.wanted_total > r.reachable_total for r in full)


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "id bigint, t string, s string")
    m = mixture.mix(docs, "id", "t", "s", sources(spark, [("a", 1.0, 2)]))
    assert m.copies.count() == 0 and m.report.first().actual_share == 0
    with pytest.raises(ValueError):
        mixture.mix(docs, "id", "t", "s", sources(spark, [("a", 0.5, 2), (" A", 0.5, 2)]))


# ---- labels

PROSE = "The parser reads the file and writes what it found into the table. If a row is broken, it is kept for later.\n"
PAGES = {
    "prose": PROSE * 6,
    "lower": "the parser reads the file and writes what it found into the table if a row is broken it is kept for later\n" * 4,
    "references": PROSE * 8 + "References\n[1] https://one.example/a\n[2] www.two.example/b\n",
    "annotated": "".join(f"- https://s{i}.example/p : The parser reads the file and writes what it found into the table.\n" for i in range(8)),
    "japanese": "その後、記録と索引が保存した。通知が足りない時は、先に見直した。\n" * 5,
    "links": "".join(f"https://s{i}.example/p{i}.html\n" for i in range(12)),
    "anchors": "".join(f'<a href="https://s{i}.example/">red shoe sale</a><br>' for i in range(12)),
    "keywords": "buy shoe cheap shoe online shoe best price shoe " * 20,
    "fake": "Buy red shoe best red shoe cheap red shoe. Red shoe deal, red shoe sale, red shoe price! " * 5,
    "tags": "#RedShoe #CheapShoe #ShoeSale #BuyShoe " * 10,
    "menu": "Home > Shoes > Red > Sale\nHome > Shoes > Blue > Sale\nHome > Hats > Green > Deal\n" * 4,
    "spaced": "r e d _ s h o e ch3ap sh03 r e d _ s h o e " * 10,
    "mostly": PROSE + "".join(f"https://s{i}.example/page/number/{i}.html\n" for i in range(40)),
    "partly": PROSE * 9 + "".join(f"https://s{i}.example/p{i}.html\n" for i in range(6)),
}
SPAM = {"links", "anchors", "keywords", "fake", "tags", "menu", "spaced", "mostly"}


def test_labels(spark):
    names = list(PAGES)
    rows = [(i, PAGES[k]) for i, k in enumerate(names)] + [(100, None), (101, ""), (102, " \n "), (None, PAGES["links"]), (0, PAGES["prose"]), (103, "." * 100_000), (104, "buy shoe " * 50_000)]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("id", "t", "1 as text", "2 as spam", "3 as prose")
    out = spam.page_shares(df, "id", "t").collect()
    assert len(out) == len(rows)
    assert {names[r.id] for r in out if r.spam and r.id is not None and r.id < 100} == SPAM
    assert not any(r.spam for r in out if r.id in (100, 101, 102)) and next(r for r in out if r.id == 104).spam
    assert spam.page_shares(df.limit(0), "id", "t").count() == 0


def random_page(r, n):
    return np.array([[r.randrange(-1, len(f.edges) + 1) for f in spam.FEATURES] for _ in range(n)], np.int8)


def test_viterbi_is_the_best_path():
    from itertools import product

    r = random.Random(3)
    model = spam.prior()
    for _ in range(10):
        seen = random_page(r, 4)
        score = model.scores(seen)

        def total(path, score=score):
            return model.start[path[0]] + sum(score[t, s] for t, s in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False))

        got = spam.label(seen, model)
        assert total(got) == pytest.approx(max(total(p) for p in product(range(len(spam.STATES)), repeat=4)))


def test_fitting_makes_pages_likelier():
    """Baum-Welch without prior weight never makes what was seen less likely."""
    r = random.Random(5)
    pages = [random_page(r, r.randint(1, 6)) for _ in range(40)]

    def likelihood(model):
        total = 0.0
        for seen in pages:
            score = model.scores(seen)
            ahead = model.start + score[0]
            for t in range(1, len(seen)):
                ahead = spam._log_sum(ahead[:, None] + model.move, 0) + score[t]
            total += spam._log_sum(ahead, 0)
        return total

    steps = [likelihood(spam.fit(pages, rounds=k, weight=1e-6)) for k in range(5)]
    assert all(b >= a - 0.5 for a, b in zip(steps, steps[1:], strict=False)) and steps[-1] > steps[0]
    assert all((a == b).all() for f, a, b in zip(spam.FEATURES, spam.prior().emit, spam.fit(pages).emit, strict=True) if not f.fitted)


# Two lines of plain prose in languages the model was never shown, source code, data and verse.
PLAIN = {
    "Chinese": "今天的天气很好，我们一起去公园散步，看到了许多美丽的花朵。\n晚上回家以后，妈妈做了一顿丰盛的晚餐，大家都很高兴。",
    "Russian": "Вчера мы ходили в старый музей, где увидели много интересных картин.\nПотом дети захотели мороженого, и мы зашли в маленькое кафе у реки.",
    "Polish": "Wczoraj poszliśmy do starego muzeum, gdzie zobaczyliśmy wiele ciekawych obrazów.\nPotem dzieci chciały lodów, więc wstąpiliśmy do małej kawiarni nad rzeką.",
    "Korean": "어제 우리는 오래된 박물관에 가서 흥미로운 그림을 많이 보았다.\n그 후 아이들이 아이스크림을 먹고 싶어 해서 강가의 작은 카페에 들렀다.",
    "Arabic": "ذهبنا أمس إلى المتحف القديم حيث رأينا العديد من اللوحات المثيرة للاهتمام.\nثم أراد الأطفال المثلجات فدخلنا إلى مقهى صغير بجانب النهر.",
    "Italian": "Ieri siamo andati al vecchio museo, dove abbiamo visto molti quadri interessanti.\nPoi i bambini volevano il gelato e siamo entrati in un piccolo bar sul fiume.",
    "Thai": "เมื่อวานนี้เราไปพิพิธภัณฑ์เก่าและได้เห็นภาพวาดที่น่าสนใจมากมาย\nหลังจากนั้นเด็กๆ อยากกินไอศกรีม เราจึงแวะร้านกาแฟเล็กๆ ริมแม่น้ำ",
    "code": "import os\nimport sys\n\ndef main(path):\n    total = 0\n    for name in os.listdir(path):\n        size = os.path.getsize(os.path.join(path, name))\n        total += size\n    return total\n",
    "data": '{"name": "alpha", "items": [{"id": 1, "title": "First"}, {"id": 2, "title": "Second"}],\n "status": "open", "owner": {"name": "bo", "mail": "bo@x.org"}}',
    "verse": "A lamp is lit\nbeside the quiet water.\n\nThe boats come home\nwithout a sound\nand wait for morning\nat the gate.",
}
STUFFED = {
    "one line": "Buy the cheap shoes and the best shoes for the running shoes because the shoes are the best cheap shoes. " * 6,
    "lines": "Buy the cheap shoes and the best shoes for the running shoes if you need shoes.\nThe best running shoes are the cheap shoes that you can buy with other shoes.\n"
    "For the cheap running shoes you should buy the best shoes in the shoes shop.\n" * 3,
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_no_language_is_spam_and_stuffed_sentences_are(spark):
    """With a model fitted to a corpus of other languages."""
    model = spam.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    share = lambda t: (lambda x: sum(len(line) for line, label in x if label) / sum(len(line) for line, _ in x))(spam.label_text(t, model))
    assert {k: share(v) for k, v in PLAIN.items() if share(v) > 0.5} == {}
    assert {k: share(v) for k, v in STUFFED.items() if share(v) <= 0.5} == {}
