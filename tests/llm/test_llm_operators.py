"""The operators against plain Python versions on a small fixture of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import (chat, embedding_dedup, fingerprints, licenses, line_dedup, mixing, ngram_join, packing,
                           quality, substring_dedup)

SEP = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases: null, empty and blank texts, ties, repeated rows, a null id, a long text, clashing extra columns."""
    line = "this common line of text is surely longer than forty characters"
    body = " ".join(f"w{i}" for i in range(120))
    rows = [(i, f"{line}\nown words {i} " + " ".join(f"x{i}y{j}" for j in range(60))) for i in range(8)]
    rows += [(20, body), (21, body), (22, body + " tail"), (23, " ".join(f"q{i}" for i in range(30)) + " " + body),
             (24, body), (24, body), (30, None), (31, ""), (32, " \t\n "), (33, "mit"), (34, "a b c"), (35, "A b c"),
             (None, body), (40, "\n\n".join([line.upper() + "  "] * 3)),
             (41, " ".join(f"long{i % 5000}" for i in range(30_000))), (42, "x CC BY-NC 4.0, MIT License;GNU General "
              "Public License ünï apache\tlicense.")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, key string, "
                                 "n_words string")


def words(text):
    return [w for w in SEP.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def united(links, ids):
    top = {i: i for i in ids}
    while True:
        before = dict(top)
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
        if top == before:
            return top


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup(docs, broadcast_bytes):
    rows = rows_of(docs)
    key = lambda line: lower(line.strip(line_dedup.STRIP))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept), "b"))
    out = line_dedup.line_dedup(docs, broadcast_bytes=broadcast_bytes)
    got = [(r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"], r["n_words"]) for r in out.collect()]
    assert Counter(got) == Counter(want) and sum(r[3] for r in want) == 8


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    _, _, rest, slots = line_dedup.build_mphf(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and len(rest) < 10


def test_substring_dedup(docs):
    rows = [r for r in rows_of(docs)]
    owner = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for p in range(len(w) - 49):
            owner.setdefault(tuple(w[p:p + 50]), i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 49):
            if i is not None and owner[tuple(w[p:p + 50])] < i:
                gone.update(range(p, p + 50))
        want.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs).collect()]
    assert Counter(got) == Counter(want) and any(r[3] for r in want)


def test_substring_dedup_of_repeated_ids(spark):
    long, other = [f"a{i}" for i in range(130)], [f"b{i}" for i in range(60)]
    docs = spark.createDataFrame(
        [(1, " ".join(long)), (2, " ".join(other + long[:120])), (2, " ".join(long[60:115])), (2, "short"),
         (3, " ".join(other))], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == Counter([(1, 130, 0), (2, 180, 120), (2, 55, 55), (2, 1, 0), (3, 60, 60)])


@pytest.mark.parametrize("k,num,den,small", [(4, 85, 100, False), (5, 80, 100, False), (5, 80, 100, True)])
def test_ngram_join(spark, docs, monkeypatch, k, num, den, small):
    if small:  # keys of several parts, parts of several squares
        monkeypatch.setattr(ngram_join, "BLOCK", 3)
        monkeypatch.setattr(ngram_join, "KEYS_PER_PART", 150)
    rng = np.random.default_rng(3)
    more = []
    for c in range(6):  # chains of edits, so that groups hold linked and unlinked documents
        base = [f"c{c}v{v}" for v in rng.integers(0, 10_000, 90 + 40 * c)]
        for e in range(14):
            base = list(base)
            for p in rng.integers(0, len(base), int(rng.integers(0, 5))):
                base[p] = f"e{rng.integers(0, 1_000_000)}"
            more.append((1000 + 100 * c + e, " ".join(base)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {}
    for i, t in rows_of(both):
        if i is not None:
            w = words(lower(t))
            sets[i] = {tuple(w[p:p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    top = united(links, ids)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           ngram_join.ngram_components(both, k, num, den).collect()}
    assert got == {i: (len(sets[i]), top[i]) for i in ids} and len(set(top.values())) < len(ids) - 20
    kept = [r["doc_id"] for r in ngram_join.drop_near_duplicates(both, k, num, den).collect()]
    assert Counter(kept) == Counter([None, *set(top.values())])


def test_near_duplicates_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "one text", "x"), (1, "one text", "x"), (1, "quite another text", "y"), (2, "z", "z")],
                                 "doc_id long, text string, _lost string")
    kept = [tuple(r) for r in ngram_join.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == [(1, "one text", "x"), (1, "quite another text", "y"), (2, "z", "z")]


def test_quality_fit_is_bounded_by_rows(spark, monkeypatch):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {n} of {i}") for i in ids[:8] for n in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids[:8]], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    quality.train(docs, labels, max_rows=5)
    assert seen == [5]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base + rng.standard_normal((60, 16)) * s for s in (0, 0.05, 0.1, 0.2, 0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16),
             (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_components(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    links = [(a, b) for a in range(len(x)) for b in range(a) if near[a, b]] + [(906, 907)]
    top = united(links, [i for i, _ in rows if i is not None])
    n = Counter(i for pair in links for i in pair)
    assert got == {**{i: (n[i], top[i], top[i] == i) for i in top}, None: (0, None, True)}


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows_of(docs):
        w = split.findall(lower(t))
        places = [(p, label) for phrase, label in licenses.BASE for p in range(len(w))
                  if w[p:p + len(phrase.split())] == phrase.split()]
        r = got[i]
        at = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[42]["n_base"] == 4


def test_license_notices(spark):
    """Labels and score of altered notices, against a plain search of every indexed start."""
    texts = [t for _, t, _ in licenses.NOTICES]
    grant = next(t for label, t, _ in licenses.NOTICES if label == "mit-grant")
    altered = [grant.replace(w, "zzz") for w in ("charge", "copy", "files", "permission")]
    rows = [(1, grant), (2, altered[0]), (3, " ".join(f"w{i}" for i in range(400)) + " " + " ".join(texts[:4]) + " x " + altered[0]),
            (4, altered[1] + " " + " ".join(reversed(texts))), (5, altered[2]), (6, altered[3]), (None, "the MIT license"),
            (None, "nothing here"), (7, "mit license"), (7, "released, under the"), (7, "mit license"), (8, None), (9, "cc by nc"),
            (10, "Licensed under CC-BY-NC 4.0"), (11, "by cc " * 30 + "cc by"), (12, texts[2].replace("modify", "change"))]
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = [split.findall(lower(t)) for _, t in rows]
    templates = [(b, p.split(), p.split(), True) for p, b in licenses.BASE] + [
        (b, t.split(), k.split(), False) for b, t, k in licenses.NOTICES]
    vocabulary = {w for _, t, _, _ in templates for w in t}
    df = Counter(w for words_of in {(i, tuple(f)) for (i, _), f in zip(rows, found)} for w in set(words_of[1]))
    idf = {w: np.log((len(rows) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    want = Counter()
    for (i, _), w in zip(rows, found):
        labels, score = set(), 0.0
        for label, t, key, base in templates:
            rare = licenses.rare_words(t, idf)
            at = next(x for x in range(len(t)) if t[x:x + len(key)] == key)
            for start in range(len(w)):
                here = [w[start + x] if start + x < len(w) else None for x in range(len(t))]
                if not any(t[x] == here[x] and t[x] in rare for x in range(len(t))):
                    continue
                same = [x for x in range(len(t)) if t[x] == here[x]]
                share = 1.0 if len(same) == len(t) else sum(idf[t[x]] for x in same) / sum(idf[x] for x in t)
                score = max(score, share)
                if share == 1.0 if base else share >= licenses.MIN_SHARE and set(range(at, at + len(key))) <= set(same):
                    labels.add(label)
        want[i, ",".join(sorted(labels)), round(score, 9)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.license_scan(docs).collect()
    assert Counter((r["doc_id"], r["labels"], r["score"]) for r in out) == want
    got = {r["doc_id"]: r["labels"] for r in out}
    assert got[2] == "mit-grant" and "mit-grant" in got[3] and "mit-grant" in got[4] and got[6] == ""
    assert (None, "mit", 1.0) in want and (7, "mit", 1.0) in want


def test_fingerprints(docs):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    prints = {}
    for n, ((i, t), r) in enumerate(zip(rows, got)):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert (r["doc_id"], r["n_chars"]) == (i, len(t))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1
    assert got[-1]["near_edited"] < 1


def test_chat_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "<\\|im_start|>", "<<SYS>>", "a < b | c", "", None, "\n\n", "[[INST]"]
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["user", "assistant"] * 5, nasty))]
    rows += [(2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 1, None, "a"), (None, 1, "tool\n%0A", "x")]
    out = chat.format_trees(chat.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["tree"]: r for r in out.select("tree", chat.read_back(F.col("formatted")).alias("t"),
                                            chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want["none" if c is None else str(c)].append((r or "", x or ""))
    assert {k: [tuple(x) for x in v["t"]] for k, v in got.items()} == dict(want)
    assert all(v["loss"] == "".join(x for r, x in want[k] if r == "assistant") for k, v in got.items())


def test_reply_trees_rank_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 3.0),
            ("t", 4, 3, "user", "more", 0.0), ("t", 7, 99, "user", "orphan", 0.0), ("c", 1, 2, "u", "x", 0.0),
            ("c", 2, 1, "u", "y", 0.0)]
    out = chat.format_trees(spark.createDataFrame(
        rows, "tree string, node long, parent long, role string, text string, score double"), top=2).collect()
    assert {(r["tree"], r["leaf"], r["rank"]) for r in out} == {("t", 4, 1), ("t", 2, 2)}


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = [r.asDict() for r in packing.pack_documents(docs, with_ids=True).collect()]
    want = Counter()
    for i, t in rows_of(docs):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            raw = np.array(ids[at:at + 2048], "<u4").tobytes()
            want[i, at, len(raw) // 4, len(ids), zlib.crc32(raw), raw] += 1
    assert want == Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == s[0]["sequence_tokens"] <= 2048


def test_tokens_as_in_a_plain_call():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, ours = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|><|endoftext|>b.", "<|EndOfText|> x", "<|endoftext",
             " <|startoftext|>\n\nIt's 3.5<|endoftext|>!", "no added token.", "", "é<|endoftext|>É <|startoftext|> ."]
    got = [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [3306, 49407, 1002]


def test_recipe_uses_every_piece():
    counts = np.bincount(np.random.default_rng(2).integers(1, 2049, 5000), minlength=2049)
    used = np.zeros(2049, np.int64)
    for lengths, n in packing.recipe(counts):
        assert sum(lengths) <= 2048 and n > 0
        used += n * np.bincount(lengths, minlength=2049)
    assert (used == counts).all()


def test_quality(spark, docs):
    good = [(100 + i, "plain words in a row " * (3 + i % 5), 1) for i in range(120)]
    bad = [(300 + i, "$$$ 12 !!! ## " * (3 + i % 7), 0) for i in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    out = quality.score_quality(rows, labels).toPandas().set_index("doc_id")
    truth = {i: q for i, _, q in good + bad}
    assert all(out.predicted[i] == truth[i] for i in out.index[out.held_out])
    assert all(out.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out.index)
    assert quality.score_quality(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality.keep_quality(docs, labels).columns == docs.columns


def test_raking_meets_its_marginals(docs):
    rng = np.random.default_rng(4)
    cells = {(s, g, t): float(rng.integers(1, 1000)) for s in "abc" for g in "xy" for t in "pq"}
    targets = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"x": 3, "y": 1}, "topic": {"p": 1, "q": 1}}
    weight = mixing.rake(cells, targets)
    total = sum(cells.values())
    for d, name in enumerate(mixing.DIMENSIONS):
        for v, share in targets[name].items():
            have = sum(weight[k] * m for k, m in cells.items() if k[d] == v)
            assert abs(have - total * share / sum(targets[name].values())) < 1e-6 * total
    chance = mixing.calibrate(cells, weight, 0.5)
    assert abs(sum(chance[k] * m for k, m in cells.items()) - 0.5 * total) < 1e-6 * total
    out = mixing.mixture(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["probability"] <= 1 for r in out)
    assert mixing.sample_mixture(docs).count() == sum(r["kept"] for r in out)


def test_bounded_raking_meets_targets_or_keeps_all():
    rng = np.random.default_rng(5)
    cells = {(s, g, t): float(rng.integers(1, 1000)) for s in "abc" for g in "xy" for t in "pq"}
    cells |= {("big", g, t): 4000.0 for g in "xy" for t in "pq"}
    total = sum(cells.values())
    even = {"source": dict.fromkeys(["a", "b", "c", "big"], 1), "lang": {"x": 3, "y": 2}, "topic": {"p": 1, "q": 1}}
    have = {v: sum(m for k, m in cells.items() if k[0] == v) for v in even["source"]}
    for share in (0.3, 0.6):
        chance = mixing.rake_bounded(cells, even, share)
        assert all(0 <= p <= 1 for p in chance.values())
        assert abs(sum(chance[k] * m for k, m in cells.items()) - share * total) < 1e-6 * total
        got = mixing.shares(cells, chance)
        full = {v for v in "abc" if have[v] < share * total / 4}
        if share == 0.3:
            assert not full and max(chance.values()) == 1  # the targets are within reach, but only under the bound
        else:
            assert full
        for d, name in enumerate(mixing.DIMENSIONS):
            for v, t in even[name].items():
                want = t / sum(even[name].values())
                if full and name == "source":
                    want = have[v] / (share * total) if v in full else None
                assert want is None or abs(got[d][v] - want) < 1e-3, (share, name, v)


def test_sample_has_the_target_shares(spark):
    rows = [(i, "w " * (120 + i % 7) + ("1 " * 40 if i % 3 else ""), "es" if i % 11 == 0 else "en",
             "big" if i % 3 == 1 else f"s{i % 4}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixture(frame, share=0.4).toPandas()
    kept = out[out.kept]
    for d in mixing.DIMENSIONS:
        got = kept.groupby(d).n_tokens.sum() / kept.n_tokens.sum()
        for v, row in out.groupby(d).first().iterrows():
            assert abs(row[f"{d}_reached"] - row[f"{d}_target"]) < 1e-6
            assert abs(got[v] - row[f"{d}_target"]) < 0.03
    short = mixing.mixture(frame, {"lang": {"es": 1, "en": 1}}, share=0.9).toPandas()
    assert (short[short.lang == "es"].probability > 0.999).all()
    es = short[short.lang == "es"].iloc[0]
    assert es.lang_target == 0.5 and abs(es.lang_reached - short[short.lang == "es"].n_tokens.sum()
                                         / (0.9 * short.n_tokens.sum())) < 1e-3


def many_sources(spark, sources):
    # A third of all rows in one source, the others with one to four documents each.
    rows = [(i, "w " * (10 + i % 5), "es" if i % 7 == 0 else "en", "big") for i in range(sources)]
    rows += [(sources + 4 * i + j, "w " * (10 + i % 9), "es" if (i + j) % 3 == 0 else "en", f"site{i}.example")
             for i in range(sources) for j in range(1 + i % 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_every_source_keeps_its_target(spark):
    frame = many_sources(spark, 700)
    out = mixing.mixture(frame, {"source": {"big": 3, "site3.example": 1}}, share=0.005).toPandas()
    assert set(out[out.probability > 0].source) == {"big", "site3.example"}
    assert abs(out[out.source == "site3.example"].source_reached.iloc[0] - 0.25) < 1e-6
    out = mixing.mixture(frame, share=0.05).toPandas().groupby("source").agg({"n_tokens": "sum", "source_target": "first"})
    tempered = out.n_tokens ** mixing.TEMPERING["source"]
    assert len(out) == 701 and (abs(out.source_target - tempered / tempered.sum()) < 1e-9).all()


def test_raking_as_a_table_equals_raking_on_the_driver(spark, monkeypatch):
    frame = many_sources(spark, 60)
    targets = {"source": {"big": 30, **{f"site{i}.example": 1 + i % 2 for i in range(50)}}, "lang": {"en": 3, "es": 2}}
    plain = mixing.mixture(frame, targets, share=0.4).toPandas().set_index("doc_id")
    kept = {r.doc_id for r in mixing.sample_mixture(frame, targets, share=0.4).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 10)
    table = mixing.mixture(frame, targets, share=0.4).toPandas().set_index("doc_id").loc[plain.index]
    assert kept == set(plain.index[plain.kept]) and (table.source == plain.source).all()
    for c in ["probability", *mixing.REPORTED]:
        assert abs(table[c] - plain[c]).max() < 5e-3, c
    assert (abs(table.weight - plain.weight) < 5e-3 * (1 + plain.weight)).all()


def test_empty_tables(docs):
    none = docs.where("false")
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert ngram_join.ngram_components(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert mixing.mixture(none).count() == 0
