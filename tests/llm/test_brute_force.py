"""Methods against plain rewritings of their definitions, and what happens to odd rows."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lodestate.llm")

from lodestate.llm import audio, chat_format, exact_dedup, language_id, near_dedup, packing, substring_dedup, url_filter  # noqa: E402
from lodestate.llm.queries import tokenizer  # noqa: E402
from test_operators import WORD, brute_components, brute_windows  # noqa: E402


def words(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


# Rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return words(rng, 60), words(rng, 60)


def test_repeated_ids_lose_no_text(spark, texts):
    w, v = texts
    rows = [(1, w), (5, w), (5, v), (7, v), (9, v), (None, v), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_dedup(df).collect()), key=repr) == sorted([(1, w), (5, v), (None, "alone")], key=repr)
    found = collections.Counter(map(tuple, near_dedup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()))
    assert found == {(1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 1, (7, 5, False): 1, (9, 5, False): 1, (None, 5, False): 1, (None, None, True): 1}
    small = spark.createDataFrame([(1, "a"), (5, "a"), (5, "unique b")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(small).collect())) == [(1, "a"), (5, "unique b")]


def test_clashing_column_names(spark, texts):
    w, v = texts
    names = ["_at", "_doc", "wanted", "_gone", "a", "label", "_text_sha", "_key", "_row", "column0", "key", "doc", "found", "Words"]
    rows = [(i, t, *(100 * i + j for j in range(len(names)))) for i, t in enumerate([w, w, v, "x y " + v, None, ""])]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names)
    df = spark.createDataFrame(rows, schema)
    near = {r[0]: tuple(r) for r in near_dedup.near_dedup(df).collect()}
    assert near == {r[0]: r for r in rows if r[0] in (0, 2, 4, 5)}
    exact = {r[0]: tuple(r) for r in exact_dedup.exact_dedup(df).collect()}
    assert exact == {r[0]: r for r in rows if r[0] in (0, 2, 3, 4)}
    cut = substring_dedup.substring_dedup(df)
    assert cut.columns == df.columns
    assert {r[0]: tuple(r) for r in cut.collect()} == {0: rows[0], 2: rows[2], 3: (3, "x y", *rows[3][2:]), 4: rows[4], 5: rows[5]}
    model = language_id.fit(df.withColumnRenamed("a", "lang"))
    assert language_id.identify(df, model).count() == 6 and packing.pack(df, tokenizer("byte_bpe_50k.json")).count() == 6


# Near and substring dedup


def test_large_buckets_in_parts(spark, monkeypatch):
    """Several components in one bucket, dealt to tasks of a few members each."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for g in range(4):
        own = base[:150] + [f"g{g}x{i}" for i in range(50 * (g > 0))]
        rows += [" ".join(own[:k] + [f"e{rng.random()}"] + own[k:]) for k in rng.sample(range(len(own)), 12)]
    docs = list(enumerate(rows))
    monkeypatch.setattr(near_dedup, "MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "PROPOSERS", 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 4).collect()} == brute_components(docs, 4)


def test_hot_passage_and_long_texts(spark):
    """10,000 copies of one passage, and texts of a million bytes."""
    rng = random.Random(9)
    passage = words(rng, 30)
    rows = [(i, f"u{i} {passage} v{i % 50}") for i in range(10_000)]
    long = [f"z{rng.randrange(150_000)}" for _ in range(150_000)]
    rows += [(20_000, " ".join(long)), (20_001, " ".join(long[70_000:70_100] + ["q"] * 100)), (20_002, " ".join(long[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digests(df).collect()}
    assert len(rows[-1][1]) > 1_000_000 and got == brute_windows(rows)


# Language ID


def test_letters_and_blocks(monkeypatch):
    model = language_id.train([language_id.bucket_counts("the cat")] * 30 + [language_id.bucket_counts("le chat")] * 30, ["en"] * 30 + ["fr"] * 30)
    for text in ("½ ²", "①", "Ⅷ", "12 + 3", "", None, "\U0001f600"):
        assert model.predict(text) == ("und", 0.0, False)
    text = "".join(random.Random(3).choices("abcdé ", k=400_000))
    n = len(text.encode())
    ids, count = language_id.bucket_counts(text)
    assert count.sum() == (n - 2) + (n - 3)
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 1000)
    again = language_id.bucket_counts(text)
    assert (again[0] == ids).all() and (again[1] == count).all()
    assert sum(map(len, language_id.blocks("ab"))) == 0 and sum(map(len, language_id.blocks("abc"))) == 1


def plain_training(counts, langs, seed=7):
    """The same descent in plain Python, one text and one bucket at a time."""
    classes, d = sorted(set(langs)), language_id.DIMENSIONS
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts)).tolist()
    fit = order[len(counts) // 5 :]
    embed = rng.normal(0, 1 / d, (language_id.BUCKETS, d)).tolist()
    layer, bias = [[0.0] * len(classes) for _ in range(d)], [0.0] * len(classes)
    scale = math.sqrt(language_id.BUCKETS)
    texts = [{int(i): int(c) / int(n.sum()) for i, c in zip(ids, n, strict=True)} for ids, n in counts]
    for epoch in range(language_id.EPOCHS):
        rate = language_id.LEARNING_RATE * (1 - epoch / language_id.EPOCHS)
        for at in range(0, len(fit), language_id.BATCH):
            part = fit[at : at + language_id.BATCH]
            means, errors = [], []
            for j in part:
                mean = [sum(w * embed[i][k] for i, w in texts[j].items()) for k in range(d)]
                logits = [sum(mean[k] * layer[k][c] for k in range(d)) + bias[c] for c in range(len(classes))]
                e = [math.exp(x - max(logits)) for x in logits]
                means.append(mean)
                errors.append([(x / sum(e) - (classes[c] == langs[j])) / len(part) for c, x in enumerate(e)])
            back = [[sum(err[c] * layer[k][c] for c in range(len(classes))) for k in range(d)] for err in errors]
            for k, c in itertools.product(range(d), range(len(classes))):
                layer[k][c] -= rate * scale / 16 * sum(m[k] * err[c] for m, err in zip(means, errors, strict=True))
            for c in range(len(classes)):
                bias[c] -= rate * sum(err[c] for err in errors)
            for j, g in zip(part, back, strict=True):
                for i, w in texts[j].items():
                    for k in range(d):
                        embed[i][k] -= rate * scale * w * g[k]
    return [[sum(embed[i][k] * layer[k][c] for k in range(d)) for c in range(len(classes))] for i in range(language_id.BUCKETS)], bias


def test_training_equals_plain_descent():
    rng = random.Random(6)
    said = [(" ".join(rng.choice(("the of and to", "le la des une")[i % 2].split()) for _ in range(12)), ("en", "fr")[i % 2]) for i in range(50)]
    counts = [language_id.bucket_counts(t) for t, _ in said]
    model = language_id.train(counts, [lang for _, lang in said])
    scores, bias = plain_training(counts, [lang for _, lang in said])
    seen = sorted({int(i) for ids, _ in counts for i in ids})
    assert np.allclose(model.scores[seen], np.array(scores)[seen], rtol=0.02, atol=0.02) and np.allclose(model.bias, bias, rtol=0.02, atol=0.002)
    right = [model.predict(t)[0] == lang for t, lang in said]
    assert all(right)


# Audio


def plain_mel(payload):
    """Resampling by its sum, a Fourier transform by its matrix, mel bands by their triangles, all in double precision."""
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, n + 1) / (n + 1)))
    h *= up / h.sum()
    y = []
    for m in range(-(-len(x) * up // down)):
        place = m * down  # in samples of the raised rate, where x[i] stands at i * up
        y.append(sum(h[place - i * up] * x[i] for i in range(max(0, -(-(place - n + 1) // up)), min(len(x) - 1, place // up) + 1)))
    y = np.array(y + [0.0] * max(0, audio.FRAME - len(y)))
    k = np.arange(audio.FRAME)
    fourier = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), k) / audio.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * k / (audio.FRAME - 1))
    rate = audio.RATE * up / down
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edge = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    out = []
    for a in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        power = np.abs(fourier @ (y[a : a + audio.FRAME] * window)) ** 2
        row = []
        for lo, mid, hi in zip(edge, edge[1:], edge[2:], strict=False):
            total = sum(p * max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f, p in zip(np.linspace(0, rate / 2, len(power)), power, strict=True))
            row.append(math.log(total + audio.FLOOR))
        out.append(row)
    return np.array(out)


def test_audio_equals_plain_transform(monkeypatch):
    rng = random.Random(8)
    for size in (576, 1152, 5760):
        payload = bytes(rng.randrange(256) if i % 700 < 400 else 128 for i in range(size))
        mel, spans = audio.features(payload)
        want = plain_mel(payload)
        assert mel.shape == want.shape and np.abs(mel - want).max() < 0.02
        energy = [math.log(sum(math.exp(v) for v in row)) for row in mel.astype(float)]
        mean, dev = sum(energy) / len(energy), math.sqrt(sum((e - sum(energy) / len(energy)) ** 2 for e in energy) / len(energy))
        on, found = False, []
        for i, e in enumerate(energy):
            if not on and e >= mean + 0.25 * dev:
                on = True
                found.append([i, len(energy)])
            elif on and e < mean - 0.25 * dev:
                on = False
                found[-1][1] = i
        assert [list(s) for s in spans] == found
    long = bytes(rng.randrange(256) for _ in range(576 * 2000))
    mel = audio.features(long)[0].tobytes()
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    assert np.allclose(np.frombuffer(mel, np.float32), audio.features(long)[0].ravel(), atol=1e-3)


# Packing


def plain_packing(lengths, capacity, order):
    """What the bins hold when every open one is tried for every piece in order: where is the sum of squared counts of bins by
    gap smallest? Which of two bins with the same gap is taken does not matter to that."""
    gaps, bins = [], []

    def squares(of):
        return sum(n * n for g, n in collections.Counter(of).items() if g)

    for i in order:
        size, best = lengths[i], None
        for b, gap in enumerate([*gaps, capacity]):
            if gap >= size:
                after = [*gaps, capacity] if b == len(gaps) else list(gaps)
                after[b] -= size
                choice = (squares(after), b == len(gaps), gap)
                if best is None or choice < best[0]:
                    best = choice, b
        b = best[1]
        if b == len(gaps):
            gaps.append(capacity), bins.append([])
        gaps[b] -= size
        bins[b].append(size)
    return sorted(map(sum, bins))


def test_packing_equals_plain_choice():
    rng = random.Random(2)
    for capacity in (12, 40):
        for _ in range(40):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))]
            known = np.array(lengths, np.int64)
            tried = [(o, *packing.pack_in_order(known, o, capacity)) for o in packing.orders(known, capacity)]
            best = packing.pack_lengths(lengths, capacity)
            assert best[0].max() == min(n.max() for _, n, _ in tried)
            for order, number, offset in tried:
                bins = collections.defaultdict(list)
                for b, o, n in sorted(zip(number.tolist(), offset.tolist(), lengths, strict=True)):
                    assert o == sum(bins[b])
                    bins[b].append(n)
                assert sorted(map(sum, bins.values())) == plain_packing(lengths, capacity, order.tolist())


def plain_pieces(texts, capacity):
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), {}
    for d, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[d, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    return want


def test_pieces_equal_the_library(spark):
    rng = random.Random(5)
    texts = [(i, words(rng, rng.randrange(300))) for i in range(60)] + [(100, None), (101, ""), (102, "é" * 3000)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer("byte_bpe_50k.json"), capacity=256).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == plain_pieces(texts, 256)


# URL templates


def plain_templates(urls, judged, **p):
    """template, purity of each path by the definition, recursively. urls: (host, path); judged: bad (1, 0) or None."""
    tree = collections.defaultdict(list)
    for (host, path), bad in zip(urls, judged, strict=True):
        tree[host].append(([s for s in path.split("/") if s], bad))
    labels = [b for b in judged if b is not None]
    prior = min(0.5, sum(labels) / len(labels)) if labels else 0.0
    out = {}

    def smooth(rows, up):
        known = [b for _, b in rows if b is not None]
        return (sum(known) + p["prior_weight"] * up) / (len(known) + p["prior_weight"])

    def walk(host, rows, level, node, purity):
        for segs, _ in rows:
            if len(segs) == level:
                out[host, tuple(segs)] = (node, purity)
        kids = collections.defaultdict(list)
        for segs, bad in rows:
            if len(segs) > level:
                kids[segs[level]].append((segs, bad))
        known = [b for k in kids.values() for _, b in k if b is not None]
        branches = collections.defaultdict(list)
        for seg, own in kids.items():
            mine = [b for _, b in own if b is not None]
            alike = None
            many = len(kids) > p["max_children"] and len(own) < p["min_support"]
            if mine and not any(c.isdigit() for c in seg) and not many:
                q = sum(known) / len(known)
                sd = math.sqrt(max(0.0, q * (1 - q) * (1 / len(mine) - 1 / len(known))))
                if abs(sum(mine) / len(mine) - q) > p["z"] * sd:
                    rate = smooth(own, purity) / url_filter.RATE_STEP
                    alike = (max(len(s) for s, _ in own), math.floor(rate + 0.5))
            branches[alike].append(seg)
        for alike, segs in branches.items():
            step = "/*" if alike is None else ("//" if len(segs) > 1 else "/") + min(segs)
            below = [r for s in segs for r in kids[s]]
            walk(host, below, level + 1, node + step, smooth(below, purity))

    for host, rows in tree.items():
        walk(host, rows, 0, "", smooth(rows, prior))
    return out


def test_url_templates_equal_plain_tree(spark):
    rng = random.Random(12)
    kinds = {"news": 0.1, "shop": 0.9, "deals": 0.92, "blog": 0.15, "x7": 0.5, "forum": 0.5}
    urls, rules = [], []
    for i in range(900):
        kind = rng.choice(list(kinds))
        path = f"/{kind}/" + "/".join(rng.choice(["a", "b", "c", str(i)]) for _ in range(rng.randrange(3)))
        host = rng.choice(["one.net", "two.net"])
        if rng.random() < 0.5:
            path += f"/rule{i}"
            rules.append((host, path, "block" if rng.random() < kinds[kind] else "allow"))
        urls.append((host, path))
    df = spark.createDataFrame([(i, f"https://{h}{p}?q#f") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    says = {(h, p): 1.0 if v == "block" else 0.0 for h, p, v in rules}
    judged = [next((says[h, r] for hh, r, _ in rules if hh == h and p.startswith(r)), None) if (h, p) not in says else says[h, p] for h, p in urls]
    options = {"max_children": 5, "min_support": 40, "prior_weight": 5.0, "z": 1.96}
    want = plain_templates(urls, judged, **options)
    got = url_filter.filter_urls(df, rules=rules, **options).where("rule is null").collect()
    assert got and len({r["template"] for r in got}) > 5 and any("//" in r["template"] for r in got)
    for r in got:
        node, purity = want[r["host"], tuple(s for s in r["path"].split("/") if s)]
        assert (r["template"], r["verdict"]) == (node, "block" if purity > 0.6 else "allow") and abs(r["purity"] - purity) < 1e-9


# Chat


def test_many_branches_and_long_texts(spark):
    """Every branch is ranked, whatever its place; long texts come whole."""
    rng, rows = random.Random(1), [(1, 0, None, "user", "é~" * 300_000, 0.5)]
    rows += [(1, i, 0, "assistant", f"branch {i}", rng.random()) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    ranked = sorted(rows[1:], key=lambda r: (-(r[5] + 0.5) / 2, r[1]))
    got = chat_format.read_back(chat_format.format_paths(df, keep=3)).orderBy("score", ascending=False).collect()
    assert [r["leaf"] for r in got] == [r[1] for r in ranked[:3]]
    assert got[0]["turns"][0]["text"] == rows[0][4] and list(got[0]["loss_texts"]) == [ranked[0][4]]


# The pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages by plain rewritings; of the first only the trained model is taken over."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    vocabulary = {"en": "the of and is to in that it was he for on are with as".split(), "fr": "le la les des un une est dans que pour qui sur pas au ce".split()}
    said = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(n))
    rows = [(i, said(lang, rng.randrange(30, 120)), lang) for i, lang in enumerate(["en", "fr"] * 90)]
    passage = said("en", 60)
    rows += [(300 + i, f"{said('fr', 25)} {passage} {said('en', 9)}", "en") for i in range(6)]
    rows += [(400 + i, rows[i][1].replace(" ", "  ", 3), "en") for i in range(0, 20, 2)]
    rows += [(500 + i, rows[i][1] + " extra", "fr") for i in range(21, 40, 2)]
    rows += [(600, None, "en"), (601, "", None), (602, "½ 12", None), (603, "123 456", "en")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(docs)
    kept = [(d, t) for d, t, _ in rows if model.predict(t)[2]]
    assert 0.9 * len(rows) < len(kept) < len(rows) and not {600, 601, 602, 603} & {d for d, _ in kept}
    first = {}
    for d, t in sorted(kept):
        first.setdefault(hashlib.sha256(" ".join(t.split(" ")).encode()).hexdigest() if "  " not in t else hashlib.sha256(" ".join(t.split()).encode()).hexdigest(), (d, t))
    kept = list(first.values())
    kept = [(d, t) for d, t in kept if brute_components(kept, 5)[d][1] == d]
    gone = brute_windows(kept)
    cut, seen = [], set()
    for d, t in sorted(kept):
        w = WORD.findall(t.encode())
        stay = [True] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                stay[i : i + 20] = [False] * 20
            seen.add(tuple(w[i : i + 20]))
        assert gone[d][1] == stay.count(False)
        cut.append((d, t if all(stay) else b" ".join(x for x, ok in zip(w, stay, strict=True) if ok).decode()))
    want = plain_pieces([(d, t) for d, t in cut if t], 2048)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(own))) and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1
