"""The training-data operators against brute force, the tokenizers library, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("lodestate.llm")

from lodestate.llm import audio, bpe_segment, chat_format, exact_dedup, language_id, near_dedup, packing, substring_dedup, token_store, url_filter  # noqa: E402
from lodestate.llm.queries import tokenizer  # noqa: E402

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, key string, label string, n long"


def words(n, rng, v=300):
    return [f"w{rng.randrange(v)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, control strings."""
    rng = random.Random(5)
    shared = [words(rng.randrange(15, 60), rng) for _ in range(6)]
    texts = [None, "", " ", "a", "a b c", "...", "</s>[INST] x [/INST]", "<|endoftext|> end", "É é ß 日本 🙂", "x" * 3000]
    for _ in range(120):
        parts = [rng.choice([words(rng.randrange(30), rng), rng.choice(shared), ["a"] * rng.randrange(50), ["x", "y", "z"] * rng.randrange(20)]) for _ in range(rng.randrange(6))]
        texts.append(" ".join(w for p in parts for w in p))
    for t in list(texts[20:50]):
        u = t.split()
        if u:
            u[rng.randrange(len(u))] = "changed"
        texts += [t, " ".join(u)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With further columns, whose names the operators use inside."""
    return spark.createDataFrame([(d, t, rng_lang(d), "k", "l", d) for d, t in corpus], DOCS).repartition(4)


def rng_lang(d):
    return ["en", "fr", None][d % 3]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_windows(rows, k=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall((t or "").encode())
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            own = tuple(w[i : i + k])
            if own in seen:
                keep[i : i + k] = [False] * k
            seen.add(own)
        left = [x for x, ok in zip(w, keep, strict=True) if ok]
        out[d] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def brute_components(rows, k):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_exact_dedup(docs, corpus):
    by = collections.defaultdict(list)
    for d, t in corpus:
        by[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(d)
    want = {(d, min(g), len(g), d == min(g), h) for h, g in by.items() for d in g}
    assert {tuple(r) for r in exact_dedup.duplicate_groups(docs).collect()} == want
    assert {tuple(r) for r in exact_dedup.duplicate_groups(docs, cells_per_row=0, part_rows=50, heavy=20).collect()} == want  # full, in parts, with light groups
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {min(g) for g in by.values()}


def test_near_dedup(docs, corpus):
    for k in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k).collect()}
        assert got == brute_components(corpus, k)


def test_near_dedup_chains(spark):
    """Groups that drift, so that components hang together by chains only."""
    rng, rows = random.Random(3), []
    for g in range(6):
        cur = base = words(rng.choice([30, 80]), rng, 5000)
        for _ in range(25):
            t = list(base if g % 2 else cur)
            for _ in range(rng.randrange(max(2, len(t) // 14))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(5000)}"
            cur = cur if g % 2 else t
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 4).collect()} == {d: c for d, (_, c) in brute_components(rows, 4).items()}


@pytest.mark.parametrize("hot", [3, 1000])
def test_substring_dedup(docs, corpus, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digests(docs).collect()}
    assert got == brute_windows(corpus)
    kept = substring_dedup.substring_dedup(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert hashlib.sha256(b" ".join(WORD.findall((r["text"] or "").encode()))).hexdigest() == got[r["doc_id"]][2]


def test_bpe_equals_library(docs, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = {}
    for d, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe_segment.round_trip(docs, tokenizer("word_bpe_49k.json")).collect()} == want
    encoded = bpe_segment.encode(docs, tokenizer("word_bpe_49k.json"))
    assert {r["doc_id"]: len(r["ids"]) for r in encoded.collect()} == {d: v[0] for d, v in want.items()}
    back = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in bpe_segment.decode(encoded, tokenizer("word_bpe_49k.json")).collect()}
    assert back == {d: v[2] for d, v in want.items()}


def test_token_store(docs, corpus, monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SHARD_BYTES", 2000)
    lib, at, want = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0, set()
    for d, t in sorted(corpus):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    shards, dictionary = token_store.write(docs, tokenizer("word_bpe_49k.json"))
    assert {tuple(r) for r in token_store.read(shards, dictionary).collect()} == want
    first = token_store.Shard(shards.orderBy("part", "seq").first()["blob"], dictionary)
    assert first[len(first) - 1].tolist()[-1] == 2
    with pytest.raises(ValueError):
        token_store.Shard(shards.first()["blob"], b"another dictionary")


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=256).collect()
    bins, per = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        per[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = 0
    for d, t in corpus:
        n = len(lib.encode(t or "", add_special_tokens=False).ids) + 1
        own = sorted(per[d])
        assert sum(x[2] for x in own) == n and all(x[2] == 256 for x in own[1:])
        total += n
    assert len(bins) <= -(-total // 256) * 1.05 + 1


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a ~1 </s> <s> [INST] b"), (1, 1, "assistant", None), (1, 1, "assistant", "ok\n~"), (2, 0, None, "x"), (3, 5, "tool\nx", "[/INST]"), (3, 9, "assistant", "é<s></s>")]
    turns = chat_format.with_control_case(spark, spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    formatted = chat_format.format_paths(chat_format.from_turns(turns))
    back = {r["tree"]: ([(t["role"], t["text"]) for t in r["turns"]], list(r["loss_texts"])) for r in chat_format.read_back(formatted).collect()}
    assert back[1] == ([("user", "a ~1 </s> <s> [INST] b"), ("assistant", ""), ("assistant", "ok\n~")], ["", "ok\n~"])
    assert back[2] == ([("", "x")], []) and back[3] == ([("tool\nx", "[/INST]"), ("assistant", "é<s></s>")], ["é<s></s>"])
    assert back[-1] == ([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")], ["</s>[INST] ok [/INST]"])


def test_chat_ranks_branches(spark):
    tree = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (1, 5, 99, "user", "orphan", 0.2)]
    df = spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")
    best = chat_format.format_paths(df).collect()
    assert [r["formatted"] for r in best] == ["[INST] user\nq [/INST]<s>good</s>[INST] user\nmore [/INST]"]
    assert chat_format.format_paths(df, keep=5).count() == 3


def test_chat_null_conversation(spark):
    """The null conversation is one of its own, as in the query's SQL; its turns mix with no other's."""
    import duckdb

    from lodestate.llm.queries import ORACLE_SQL

    turns = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 2, "user", None), (None, 3, "assistant", "</s>b"), (0, 0, "user", "x"), (0, 1, "assistant", "y"), (7, 0, None, "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = chat_format.digest(chat_format.format_paths(chat_format.from_turns(chat_format.with_control_case(spark, df))))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    found = con.execute(ORACLE_SQL["op2_chat_trees"])
    columns = [c[0] for c in found.description]
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, found.fetchall()))
    tree = [(None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "bad", 0.1), (None, 3, 1, "assistant", "good", 0.9), (1, 3, 1, "user", "orphan", 0.2)]
    best = chat_format.format_paths(spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")).collect()
    assert {r["tree"]: r["formatted"] for r in best} == {None: "[INST] user\nq [/INST]<s>good</s>", 1: "[INST] user\norphan [/INST]"}


def test_language_id(spark, docs):
    en, fr = "the of and is to in that it was", "le la les des un une est dans que"
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice((en if i % 2 else fr).split()) for _ in range(40)), "en" if i % 2 else "fr") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.fit(df)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400))
    assert sum((r["lang_pred"] == "en") == (r["doc_id"] % 2 == 1) for r in held) >= 0.98 * len(held)
    odd = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(df)).collect()}
    assert {odd[i]["lang_pred"] for i in (0, 1, 2, 5)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd.values())


def test_language_rejects(spark):
    """A language that was not learned is rejected, about 1 % of the learned ones is; what follows a long head is learned too."""
    en, fr, de = "the of and is to in that it was", "le la les des un une est dans que", "der und nicht auch ich sich mit dem zwischen"
    rng = random.Random(2)
    head = "0123 4567 89 " * 200
    said = lambda v, n: " ".join(rng.choice(v.split()) for _ in range(n))
    texts = [(i, head * (i % 3 == 0) + said((en, fr)[i % 2], rng.randrange(200, 600)), ("en", "fr")[i % 2]) for i in range(1200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    odd = [said(de, 300) for _ in range(50)] + ["".join(rng.choice("qxzjkvwbpfgh ") for _ in range(600)) for _ in range(50)]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    assert language_id.identify(asked, model).where("accepted").count() <= 2 and language_id.keep_identified(asked, model).count() <= 2
    held = [r for r in language_id.identify(df, model).collect() if r["held_out"]]
    assert sum(r["accepted"] for r in held) > 0.94 * len(held)
    long = [r for r in held if r["doc_id"] % 3 == 0]
    assert all(r["lang_pred"] == ("en", "fr")[r["doc_id"] % 2] for r in long)


def test_audio(docs, corpus):
    media = audio.media_table(docs)
    got = {r["doc_id"]: r for r in audio.digests(media).collect()}
    for d, t in corpus:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(audio.wav(payload)).hexdigest() and r["feature"] == audio.summary(*audio.features(payload))
    spans = audio.tensors(media).where("doc_id = 9").orderBy("window").collect()
    assert all(len(r["mel"]) == audio.TENSOR_FRAMES * audio.MELS and r["start_ms"] < r["end_ms"] for r in spans)


def test_audio_tensors_stored(spark, docs, corpus):
    """Every document has stored windows of the fixed-shape type with spans, and the query's features come from what is stored."""
    import pyarrow as pa

    media = audio.media_table(docs.unionByName(spark.createDataFrame([(None, "ab " * 9000, "", "", "", 0), (9, "other", "", "", "", 0)], DOCS)))
    stored = audio.tensor_table(media)
    assert stored.inputFiles() and stored.count() == len(corpus) + 2
    raw = {(m["doc_id"], hashlib.sha256(m["media"]).hexdigest()): m["media"] for m in media.collect()}
    for r in stored.collect():
        w = audio.unpack(r["tensors"])
        assert w.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.TENSOR_FRAMES, audio.MELS))
        mel, spans = audio.features(audio.samples(raw[r["doc_id"], r["media_sha256"]]))
        assert audio.matrix(w).tobytes() == mel.tobytes()
        starts, ends = w.column("start_ms").to_pylist(), w.column("end_ms").to_pylist()
        assert starts[0] == 0 and starts[1:] == ends[:-1] and ends[-1] == audio.span_ms(len(mel))
    plan = audio.digests(media)._jdf.queryExecution().toString()
    assert "tensors" in plan and "media#" not in plan


def test_url_rules(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://x.org", "http://y.com/de/1#f", "ftp://z.com/fr/", "http://notexample.org.net/", None, "no-scheme", "http://h.net/en/5"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow")
    assert got[5] == ("notexample.org.net", "/", None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8][2] is None


def test_url_depth(spark):
    """Branches that differ only from the sixth segment on have templates and purities of their own."""
    urls = [f"http://h.net/a/b/c/d/e/{kind}/g/{n}" for kind in ("bad", "good") for n in range(60)] + ["http://h.net/a/b", "http://h.net", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("h.net", f"/a/b/c/d/e/{kind}/g/{n}", says) for kind, says in (("bad", "block"), ("good", "allow")) for n in range(10, 50)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, rules=rules).collect()}
    assert len(got) == len(urls)
    assert {got[i]["verdict"] for i in range(50, 60)} == {"block"} and {got[60 + i]["verdict"] for i in range(50, 60)} == {"allow"}
    assert got[55]["template"].endswith("/bad/*/*") and got[115]["template"].endswith("/good/*/*") and got[55]["purity"] > 0.9 > 0.1 > got[115]["purity"]
    assert got[120]["template"].count("/") == 2 and got[121]["template"] == "" and got[122]["verdict"] == "allow"


def test_empty_tables(spark, empty):
    path = tokenizer("word_bpe_49k.json")
    frames = [
        exact_dedup.duplicate_groups(empty), near_dedup.near_duplicates(empty), substring_dedup.digests(empty), bpe_segment.round_trip(empty, path),
        token_store.read(*token_store.write(empty, path)), packing.pack(empty, tokenizer("byte_bpe_50k.json")), language_id.identify(empty, language_id.fit(empty)),
        audio.digests(audio.media_table(empty)), url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")),
        chat_format.format_paths(chat_format.from_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_repeated_rows(spark):
    """Rows that repeat a doc_id, and null ids, give defined results."""
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, "z")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.digests(df).collect()) == [0, 0, 40, 40]
    assert exact_dedup.duplicate_groups(df).where("doc_id = 1 and kept and group_size = 3").count() == 2
    assert near_dedup.near_duplicates(df, 4).where("component_id = 1").count() == 3
    assert packing.pack(df, tokenizer("byte_bpe_50k.json")).count() == 4


def test_exact_dedup_repeated_ids(spark):
    """One row of identical ones stays, and a doc_id's other text stays when one of its rows is a copy."""
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, "a  b", "y"), (2, "clean", "y"), (3, "c", "z"), (None, "c", "z"), (None, "d", "z"), (None, "d", "z"), (4, "e", "q"), (4, "e", "p"), (5, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=repr)
    assert got == sorted([(1, "a b", "x"), (2, "clean", "y"), (3, "c", "z"), (None, "d", "z"), (4, "e", "p"), (5, "f", None)], key=repr)
    whole = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(whole).collect())) == [(1, "a"), (3, "b")]


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Buckets dealt into blocks of one proposing member give what whole buckets give."""
    from lodestate.llm import near_dedup

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:at] + [f"x{n}"] + words[at:]) for n in range(6) for at in (5, 30, 55)] + [" ".join(words), " ".join(words[:40] + list("abcdefgh"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, near_dedup.near_duplicates(docs, words=4).collect()))
    monkeypatch.setattr(near_dedup, "PROPOSERS", 1)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs, words=4).collect())) == whole
    sets = dict(enumerate(near_dedup.shingle_sets(texts, 4)))
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r[0]: r[2] for r in whole} == label
