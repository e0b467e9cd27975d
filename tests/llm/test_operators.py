"""Each operator against a brute-force version, an exact round trip, SQL or held-out accuracy."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import classifier, embeddings, html_text, minhash, mixing, packing, quality_rules, substring, token_rollup, tokens, warc
from marlstone.llm import queries as q
from marlstone.llm.common import components, read
from marlstone.llm.hashing import word_hashes
from marlstone.storage import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)

EDGES = [
    (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t\n "), (10**6 + 3, "one"), (10**6 + 4, "One"), (10**6 + 5, "a b c d"), (10**6 + 6, "a b c d e"), (10**6 + 7, "A\tB  c\nd E"),
    (10**6 + 8, "word " * 70_000), (10**6 + 9, "x" * 600_000), (10**6 + 10, "é ß ñ   \x1c 漢字 😀 <|endoftext|> don't 123 ***"), (None, "without id"), (None, None), (10**6 + 3, "one"),
    (10**6 + 11, "Some passage of the book that stands in two of them, word for word, and goes on for more than twenty words, so it is long."),
    (10**6 + 12, "before it and then Some passage of the book that stands in two of them, word for word, and goes on for more than twenty words, so it is long. after it"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The documents, rows of every odd kind, and columns with names that the operators use themselves."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 2 == 0, "src1"), "n_chars": F.length("text").cast("long")})
    extra = {"id": F.lit("x"), "grp": F.lit(1), "size": F.lit("s"), "kept": F.lit(None).cast("boolean"), "bands": F.lit(2.5), "target": F.lit(1), "score": F.lit("q"), "unit": F.lit(0)}
    return rows.unionByName(odd).withColumns(extra).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def shingles(text):
    w = WORDS.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    rounds = []

    class Counted(Scratch):
        def keep(self, df, name):
            rounds.extend(["c-m" in name] * ("c-m" in name))
            return super().keep(df, name)

    path = spark.range(1000).selectExpr("id as a", "id + 1 as b")
    assert components(path, Counted(spark, "t"), "c").where("root <> 0").count() == 0 and len(rounds) <= 12
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def test_minhash(docs, local, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(local)
    sets = defaultdict(set)
    for i, text, _ in local:
        if i is not None and (s := shingles(text)):
            sets[s].add(i)
    up = {i: i for ids in sets.values() for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    for ids in sets.values():
        for i in ids:
            union(i, min(ids))
    for a, b in combinations(sets, 2):
        both = len(a & b)
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            union(min(sets[a]), min(sets[b]))
    want = Counter((i, len(shingles(t)), None if i is None else find(i) if i in up else i, i is None or (find(i) if i in up else i) == i) for i, t, _ in local)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert minhash.near_duplicates(none).count() == 0


def test_minmax_signatures_estimate_similarity():
    a, b = (pa.array([" ".join(f"w{k}" for k in range(s, s + 400))]) for s in (0, 40))
    x, y = (next(minhash.sketcher(5, 64, 1, 7)([pa.RecordBatch.from_arrays([pa.array([1]), t], names=["doc_id", "text"])])).column("bands").to_pylist()[0] for t in (a, b))
    assert len(x) == 128 and abs(np.mean(np.array(x) == np.array(y)) - 356 / 436) < 0.12


def test_mix(spark, docs, local, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in local)
    per = Counter()
    for _, t, s in local:
        per[s] += size(t)
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(per.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * per[s]}
        for s in full or open_:
            target[s] = 2 * per[s] if full else share * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.source_size == per[r.source] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(size(t) for _, t, z in local if z == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in names)
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    copies = Counter((r.doc_id, r.text) for r in mixing.repeat(docs).collect())
    assert sum(size(t) * n for (_, t), n in copies.items()) == sum(r.taken for r in got)
    assert mixing.repeat(docs).columns == docs.columns
    assert mixing.mix(none).count() == mixing.repeat(none).count() == 0


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(q.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got = q.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(cur.fetchall())


def test_classifier(spark, sf_dir, docs, local, none):
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    more = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    got = {r.doc_id: r for r in classifier.score(more, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    odd = spark.createDataFrame([(1, None, 0), (1, 2, 0), (None, 1, 0), (2, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows = classifier.score(docs, labels.unionByName(odd)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in local) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.score(none, labels).count() == 0


def plain_features(text):
    """The classifier's indicators of a text, as tuples."""
    kinds = [set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"), set("#*$%&<>@^~=+_/\\{}[]"), {"|"}, set("!?"), set(".,;:'\"()-")]
    bits = [2, 8, 16, 32, 64, 128]
    words = WORDS.findall(text or "")
    out = {("size", min(int(np.log2(len(words) + 1)), 12)) if words else ("none",)}
    shapes = []
    for k, w in enumerate(words):
        shape = 0
        for j, c in enumerate(w):
            if "a" <= c <= "z" or ord(c) >= 128 or j == 0 and c in kinds[0]:
                shape |= 1
            else:
                shape |= sum(b for b, s in zip(bits, kinds) if c in s)
        shapes.append((shape, k > 0 and w == words[k - 1]))
    out |= {("word", w) for w in words} | {("pair", *p) for p in zip(words, words[1:])}
    for n in (1, 2, 3):
        out |= {("run", *shapes[k : k + n]) for k in range(len(shapes) - n + 1)}
    out |= {("share", s, int(np.floor(-2 * np.log2(n / len(words))))) for s, n in Counter(shapes).items()}
    return out


def test_features_and_scores_against_plain_ones(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 20_000][:120]
    texts = pa.array([t for _, t in rows], pa.string())
    wide = list(classifier.row_features(texts, 48))
    plain = [plain_features(t) for _, t in rows]
    assert [len(x) for x in wide] == [len(x) for x in plain]
    for a in range(0, len(rows), 7):
        for b in range(len(rows)):
            assert len(np.intersect1d(wide[a], wide[b])) == len(plain[a] & plain[b])
    quality = np.array([int(len(p) % 3 > 0) for p in plain])
    lists = list(classifier.row_features(texts))
    model = classifier.fit(lists, quality.astype(float))
    use = np.random.default_rng(classifier.SEED + 1).random(len(rows)) >= 0.2
    counts = {y: Counter(f for x, q, u in zip(lists, quality, use) if u and q == y for f in x.tolist()) for y in (0, 1)}
    total = {y: sum(c.values()) + (1 << classifier.BITS) for y, c in counts.items()}
    for x, score in zip(lists, model.scores(lists)):
        ratio = {f: np.log((counts[1][f] + 1) / total[1]) - np.log((counts[0][f] + 1) / total[0]) for f in x.tolist()}
        assert np.allclose(list(ratio.values()), model.ratio[x], atol=1e-5)
        length = sum(r * r for r in ratio.values()) ** 0.5
        margin = sum(r / length * float(model.weight[f]) for f, r in ratio.items()) + model.bias
        assert abs(score - 1 / (1 + np.exp(-(model.a * margin + model.b)))) < 1e-5


def test_hinge_loss_model_is_optimal():
    rng = np.random.default_rng(0)
    xs = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(80)]
    y = np.array([1.0 if 3 in x or rng.random() < 0.2 else -1.0 for x in xs])
    w = classifier.descend(xs, [np.ones(len(x)) for x in xs], y, 30, 1.0, 500, 1)
    share = {1: (y > 0).sum(), -1: (y < 0).sum()}
    cost = np.array([len(y) / (2 * share[int(v)]) for v in y])

    def loss(v):
        m = np.array([v[x].sum() + v[-1] for x in xs])
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * m)).sum()

    assert all(loss(w) <= loss(w + rng.normal(0, s, 31)) + 1e-3 for s in (0.01, 0.1) for _ in range(200))


def brute_pieces(text):
    """(words as a key, is a line, first word, word after the last, start, end) of the lines and spans of a text, cut at the least word hash of any window."""
    found = list(WORDS.finditer(text or ""))
    words = [lower(m[0]) for m in found]
    hashes, _ = word_hashes(np.frombuffer((text or "").encode(), dtype=np.uint8))
    n, cuts = len(words), {0, len(words)}
    for k in range(n - substring.WINDOW + 1):
        window = hashes[k : k + substring.WINDOW].tolist()
        cuts.add(k + max(j for j, h in enumerate(window) if h == min(window)))
    ends = [k for k in range(1, n + 1) if k == n or "\n" in text[found[k - 1].end() : found[k].start()]]
    pieces = [(True, a, b) for a, b in zip([0, *ends], ends)]
    pieces += [(False, a, min(c for c in cuts if c >= a + substring.SPAN)) for a in sorted(cuts) if a + substring.SPAN <= n]
    return [((line, *words[a:b]), line, a, b, found[a].start(), found[b - 1].end()) for line, a, b in pieces]


def brute_cuts(rows):
    """Cuts [(start, end, pieces, words)] of each of the rows (doc_id, text), which stand in the order of their keys."""
    first, repeated = {}, [[] for _ in rows]
    pieces = [brute_pieces(t) if len(t or "") < 10**5 else [] for _, t in rows]
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        for key, *place in sorted(pieces[k], key=lambda x: (x[2], x[4])):
            was = first.setdefault(key, (k, place[1]))
            if was[0] != k or place[1] >= was[1] + place[2] - place[1]:
                repeated[k].append(place)
    out = []
    for found in repeated:
        cuts, stretch = [], []
        for x in [*sorted(found, key=lambda x: (x[1], x[2])), None]:
            if stretch and (x is None or x[1] > max(y[2] for y in stretch)):
                low, high = min(y[1] for y in stretch), max(y[2] for y in stretch)
                if high - low >= substring.MIN_RUN:
                    cuts.append((min(y[3] for y in stretch), max(y[4] for y in stretch), len(stretch), high - low))
                else:
                    cuts += [(y[3], y[4], 1, y[2] - y[1]) for y in stretch if y[0]]
                stretch = []
            if x is not None:
                stretch.append(x)
        out.append(cuts)
    return out


def test_substring(spark, docs, local, none):
    rows = [(i, t) for i, t, _ in local if len(t or "") < 10**5]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"key": F.lit("x"), "spans": F.lit(1), "at": F.lit(None).cast("int")})
    cuts = brute_cuts(rows)
    want = Counter((i, *c) for (i, _), found in zip(rows, cuts) for c in found)
    got = Counter((r.doc_id, r.start, r.end, r.n_units, r.n_words) for r in substring.repeats(df).collect())
    assert got == want and sum(want.values()) > 20
    left = substring.dedup(df)
    assert left.columns == df.columns
    texts = Counter()
    for (i, t), found in zip(rows, cuts):
        kept, at = "", 0
        for a, b, *_ in sorted(found):
            kept, at = kept + t[at:a], b
        kept += (t or "")[at:]
        if not found or WORDS.search(kept):
            texts[i, kept if found else t] += 1
    assert Counter((r.doc_id, r.text) for r in left.collect()) == texts
    assert substring.repeats(none).count() == substring.dedup(none).count() == 0
    assert substring.repeats(docs).count() > 0


def test_tokens_are_the_tokenizers():
    bpe = tokens.tokenizer(tokens.VOCABULARY)
    texts = [t or "" for _, t in EDGES] + ["a\x1cb c\x85d", "²x x³ 12ab3!'s !'S they'LL'd", "é e ́x ½ À×÷ß ª_º", "<|ENDOFTEXT|> <|endoftext|>x<|startoftext|>", "İ ΑΣ ﬁ"]
    want = [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    for known in (1_500_000, 40):
        table = tokens.PieceTable(known=known)
        assert [list(x) for x in table.texts(pa.array(texts))] == want
        assert list(table.counts(pa.array([*texts, None]))) == [*map(len, want), 0]


def test_rollup(spark, docs, local, none):
    rollup = token_rollup.TokenRollup(spark, Scratch(spark, "t").path("r"))
    assert rollup.totals().count() == 0
    counts = token_rollup.counted(docs).cache()
    assert rollup.commit("a", counts) and not rollup.commit("a", counts)
    bpe = tokens.tokenizer(tokens.VOCABULARY)
    rows = {(r.doc_id, r.text): r.lang for r in docs.collect()}
    want = Counter()
    for i, t, s in local:
        k = (s, rows[i, t])
        want[*k, token_rollup.WORDS_VERSION, "n"] += len(WORDS.findall(t or ""))
        want[*k, token_rollup.BPE_VERSION, "n"] += len(bpe.encode(t or "", add_special_tokens=False).ids)
        for v in (token_rollup.WORDS_VERSION, token_rollup.BPE_VERSION):
            want[*k, v, "d"] += 1

    def totals():
        return Counter({(r.source, r.lang, r.tokenizer_version, c): r[x] for r in rollup.totals().collect() for c, x in (("n", "n_tokens"), ("d", "n_docs"))})

    assert +totals() == +want
    drafts = token_rollup.counted(docs.withColumn("text", F.concat_ws(" ", "text", F.lit("one more"))).where("source = 'src1'"))
    finals = counts.where("source = 'src1'")
    rollup.commit("a2", finals.withColumn("sign", F.lit(-1)).unionAll(drafts))
    longer = Counter({k: v + 2 * want["src1", k[1], k[2], "d"] * (k[0] == "src1" and k[2:] == (token_rollup.WORDS_VERSION, "n")) for k, v in want.items()})
    assert {k: v for k, v in totals().items() if k[2] == token_rollup.WORDS_VERSION and v} == {k: v for k, v in longer.items() if k[2] == token_rollup.WORDS_VERSION and v}
    rollup.commit("a3", drafts.withColumn("sign", F.lit(-1)).unionAll(finals))
    assert +totals() == +want
    back = counts.where("source = 'src1'").withColumn("sign", F.lit(-1))
    rollup.commit("b", back)
    assert +totals() == Counter({k: v for k, v in want.items() if k[0] != "src1" and v > 0})
    rollup.commit("c", counts.where("source = 'src1'"))
    assert +totals() == +want and rollup.batches() == ["a", "a2", "a3", "b", "c"]
    assert rollup.commit("d", token_rollup.counted(none)) and +totals() == +want
    with pytest.raises(ValueError):
        rollup.commit("../x", counts)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([b + rng.normal(size=(n, 24)) * s for b, n, s in zip(base, rng.integers(1, 12, 40), rng.choice([0, 0.1, 0.2, 0.3], 40))] + [base[:1] + rng.normal(size=(600, 24)) * 0.02])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] + [1.0] * 23), (n + 5, [float("inf")] * 24), (None, [5.0] * 24), (0, x[0].tolist()), (n + 6, [1e-200] * 24), (n + 7, [1.0, 0.0]), (n + 8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rid": F.lit("x"), "code": F.lit(1), "label": F.lit(None).cast("int")})
    got = embeddings.near_duplicates(df).collect()
    fine = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    links = Counter()
    unit = {k: np.array(rows[k][1]) / np.max(np.abs(rows[k][1])) for k in fine}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for d in {len(v) for v in unit.values()}:
        ks = [k for k in fine if len(unit[k]) == d]
        m = np.stack([unit[k] for k in ks])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.95, 1))):
            a, b = ks[a], ks[b]
            links[a] += 1
            links[b] += 1
            up[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        least = min((j for j in groups[find(k)] if j is not None), default=None)
        want[i, links[k], least, i == least] += 1
    assert Counter(tuple(r) for r in got) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_cross_polytope_recall():
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = embeddings.codes(x), embeddings.codes(0.95 * x + np.sqrt(1 - 0.95**2) * z)
    assert ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1).mean() > 0.99


def test_rules(spark, sf_dir, docs, local, none):
    docs = docs.withColumn(quality_rules.SIGNALS, F.lit(3))
    got = quality_rules.judge(docs).collect()
    want = Counter()
    for i, text, _ in local:
        text = text or ""
        w = WORDS.findall(text)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dups = set(), 0
        for x in text.split("\n"):
            if WORDS.search(x):
                dups += x in seen
                seen.add(x)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert np.mean([r.kept == (quality[r.doc_id] == 1) for r in got if r.doc_id in quality and not r.base_failed]) > 0.97
    # votes, the fit and posteriors again, in plain Python
    count = {r: {k: r[k] for k in quality_rules.COUNTS} for r in got}
    cast = {}
    for r, c in count.items():
        v = []
        for _, name, of, side, bad, good in quality_rules.RULES:
            x, base = (c[name], 1) if of is None else (100 * c[name], c[of])
            beyond = lambda limit, side: x > base * limit if side == ">" else x < base * limit  # noqa: E731,B023
            v.append(0 if not c["n_words"] else -1 if beyond(bad, side) else 1 if good is not None and not beyond(good, side) else 0)
        cast[r] = tuple(v)
    assert all(cast[r] == tuple(r[f"vote_{n}"] for n, *_ in quality_rules.RULES) for r in got)
    share, table = quality_rules.START_SHARE, [[list(c) for c in quality_rules.START_VOTES] for _ in quality_rules.RULES]
    start, every, weight = [[list(c) for c in t] for t in table], Counter(cast[r] for r in got), quality_rules.PRIOR * len(got)

    def good_chance(v):
        odds = [(1 - share), share]
        for c in (0, 1):
            for q, x in zip(table, v):
                odds[c] *= q[c][x + 1]
        return odds[1] / sum(odds)

    for _ in range(quality_rules.ROUNDS):
        chance = {v: good_chance(v) for v in every}
        mass = [sum(n * (1 - chance[v]) for v, n in every.items()), sum(n * chance[v] for v, n in every.items())]
        share = (mass[1] + quality_rules.START_SHARE * weight) / (len(got) + weight)
        for k, q in enumerate(table):
            for c in (0, 1):
                sums = [sum(n * (chance[v] if c else 1 - chance[v]) for v, n in every.items() if v[k] == x) + weight * start[k][c][x + 1] for x in (-1, 0, 1)]
                q[c][:] = [s / sum(sums) for s in sums]
    for r in got:
        assert abs(r.posterior - good_chance(cast[r])) < 1e-6 and r.kept == (not r.base_failed and r.posterior >= quality_rules.THRESHOLD)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.judge(none).count() == quality_rules.keep_good(none).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    n, n_rules = 20_000, len(quality_rules.RULES)
    good = rng.random(n) < 0.7
    votes = np.where(rng.random((n, n_rules)) < 0.4, 0, np.where((rng.random((n, n_rules)) < 0.85) == good[:, None], 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, p = quality_rules.fit(patterns, counts.astype(float), rounds=200, prior=0.001)
    assert abs(share - 0.7) < 0.05 and np.abs(p[:, 1, 2] - 0.6 * 0.85).max() < 0.05 and np.abs(p[:, 0, 0] - 0.6 * 0.85).max() < 0.05


def test_warc(spark, tmp_path):
    same = "é<p>" * 400
    rows = [(i, f"http://x/{i}", same if i % 3 == 0 else f"page {i} " * (i * 20)) for i in range(60)]
    rows += [(61, "u", None), (100, None, same), (None, "u", same), (101, "a b\n", "short"), (102, "c", "short"), (103, "d", "y" * 3_000_000), (101, "a b\n", "short"), (2**62, "far", "far away"), *((None, f"n{k}", f"without id {k} " * 30) for k in range(40))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"shard": F.lit("x"), "digest": F.lit(1), "kind": F.lit(None).cast("int")})
    files = []
    for k in range(2):
        folder = str(tmp_path / f"w{k}")
        manifest = warc.write(df.repartition(2 + k), folder, shard_bytes=20_000, file_bytes=1500)
        got = warc.read_back(manifest, folder).collect()
        files.append({r.name: (r.records, r.sha256) for r in manifest.collect()})
        names = {x.name for x in (tmp_path / f"w{k}").iterdir() if x.is_file() and x.name.endswith(".gz")}
        assert names == set(files[k]) and not [x for x in (tmp_path / f"w{k}").iterdir() if x.name.startswith(".shard")]
    assert files[0] == files[1] and len(files[0]) > 5
    shards = Counter()
    for name, (n, _) in files[0].items():
        shards[name[:12]] += n
    assert len(shards) > 5 and max(shards.values()) < 0.7 * len(rows) and len(files[0]) > len(shards)
    payload = lambda h: (h or "").encode()
    top = defaultdict(list)
    for i, _, h in rows:
        top[payload(h)].append(i)
    want = Counter()
    for i, u, h in rows:
        b = payload(h)
        ids = [x for x in top[b] if x is not None]
        first = max(ids, default=None)
        again = len(b) >= 1000 and len(top[b]) > 1 and i != first
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.digest_ok for r in got)
    folder = str(tmp_path / "none")
    assert warc.read_back(warc.write(df.limit(0), folder), folder).count() == 0


HTML = [
    ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"), ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>h<th>long<tr><td>wide cell<td>1</table>", "h          long\nwide cell  1"), ("<pre>  a\n b</pre>", "  a\n b"), ("<div hidden>x</div>y", "y"), ("<p style='display:none'>x<p>y", "y"),
    ("<span style='visibility:hidden'>x<b style='visibility:visible'>y</b></span>", "y"), ("<script>if (a<b) {}</script><style>x</style>y<!-- z -->", "y"), ("<details><summary>s</summary>no</details>", "s"),
    ("a  <b> b </b>\n c", "a b c"), ("1 < 2 & 3 &lt; 4 &copy;", "1 < 2 & 3 < 4 ©"), ("<title>t</title><h1>h</h1>x", "h\n\nx"), ("<p>never <b>closed", "never closed"), ("</p></div>x<div>", "x"), (None, ""), ("", ""),
    ("<blockquote>q</blockquote>r", "    q\n\nr"), ("<select><option>a<option>b</select>", "a\nb"), ("<table><tr><td colspan=2>over both<tr><td>a<td>b</table>", "over both\na  b"), ("<a href='>'>l</a>", "l"), ("x<", "x<"), ("x<b", "x"),
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>C<td>c1</table>", "A  b1\n   b2\nC  c1"), ("<table><tr><td>漢字<td>x<tr><td>ab<td>y</table>", "漢字  x\nab    y"),
    ("<table><tbody><tr><td rowspan=9>A<td>1<tr><td>2</tbody><tr><td>B<td>3</table>", "A  1\n   2\nB  3"), ("<table><tr><td colspan=5000>over<tr><td>a<td>b</table>", "over\na  b"),
    ("<table><tr><td><pre>a\n\nb</pre><td>x<tr><td>c<td>d</table>", "a  x\n\nb\nc  d"), ("<table><tr><td rowspan=2>a<br>b<br>c<td>x<tr><td>y<tr><td>z</table>", "a  x\nb  y\nc\nz"),
]


@pytest.mark.parametrize(("html", "text"), HTML)
def test_html(html, text):
    assert html_text.render(html) == text


def test_tables_against_a_grid():
    """Random spans: each text stands where its first row and column begin, and no two cells of a row overlap."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        n_rows, taken, html, where = int(rng.integers(1, 6)), set(), "<table>", {}
        for i in range(n_rows):
            html += "<tr>"
            at = 0
            for j in range(int(rng.integers(1, 5))):
                while (i, at) in taken:
                    at += 1
                wide, tall = (int(x) for x in rng.choice([1, 1, 1, 2, 3], 2))
                text = f"{i}{chr(97 + j)}" + ("漢" if rng.random() < 0.2 else "")
                html += f"<td colspan={wide} rowspan={tall}>{text}"
                taken |= {(i + y, at + x) for y in range(min(tall, n_rows - i)) for x in range(wide)}
                where[text] = (i, at, wide, tall)
                at += wide
        widths = Counter()
        for text, (_, at, wide, _) in where.items():
            widths[at] = max(widths[at], html_text.width(text) * (wide == 1))
        lines = html_text.render(html + "</table>").split("\n")
        starts = {c: sum(widths[x] + 2 for x in widths if x < c) for c in widths}
        for text, (i, at, _, _) in where.items():
            row = next(k for k, x in enumerate(lines) if text in x.split())
            assert lines[row].split().count(text) == 1
            before = [t for t, (y, x, w, _) in where.items() if y == i and x < at]
            if all(where[t][2] == 1 for t in lines[row].split() if where[t][1] < at):
                assert html_text.width(lines[row][: lines[row].index(text)]) == starts[at], (html, lines)
            assert all(lines[row].index(t) < lines[row].index(text) for t in before if t in lines[row].split())
        flat = [t for x in lines for t in x.split()]
        assert sorted(flat) == sorted(where)


def test_html_pages(spark, sf_dir):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        inline = {"b", "i", "a", "span", "em", "strong", "code"}

        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "head")
            self.out.append("" if tag in self.inline else " ")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head")
            self.out.append("" if tag in self.inline else " ")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = read(spark, sf_dir, "pages")
    got = {r.page_id: r for r in html_text.extract(pages.withColumns({"text": F.lit(1), "n_chars": F.lit("x")})).collect()}
    for r in pages.collect():
        w = Words()
        w.feed(r.html)
        w.close()
        marks = lambda s: [x for x in s.split() if x != "-" and not re.fullmatch(r"\d+\.", x)]
        assert marks(got[r.page_id].text) == marks("".join(w.out)) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert html_text.extract(pages.limit(0)).count() == 0
    deep = "<div>" * 20_000 + "<p>x" * 200
    assert html_text.render(deep).count("x") == 200


def test_packing(spark, docs, local, none):
    bpe = tokens.tokenizer(tokens.VOCABULARY)
    want = defaultdict(list)
    for i, t, _ in local:
        ids = np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i].append(ids)
    for settings in ({}, {"window": 256, "max_open": 8}):
        window = settings.get("window", 4096)
        got = packing.pack(docs, **settings).toPandas()
        assert (got.length > 0).all()
        fill = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        for _, g in fill:
            assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= window
        sizes = fill.length.sum()
        assert sum(window - n for n in sizes if n & (n - 1)) <= 0.01 * sizes.sum()
        by = got.sort_values("start").groupby(got.doc_id.astype("Int64"), dropna=False)
        assert sum(len(x) for v in want.values() for x in v) == got.length.sum()
        for i, g in by:
            texts = want[None if i is None or i != i else int(i)] if not (i is None or str(i) == "<NA>") else want[None]
            if len(texts) == 1:
                ids, at = texts[0], 0
                for r in g.itertuples():
                    assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
                    at += r.length
                assert at == len(ids)
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, window=1000)


def test_sum_of_squares_choice():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0, window=64, levels=16)
    for _ in range(500):
        size = int(rng.integers(1, 64))
        n, steps = packer.level, max(1, round(size / 4))
        options = {h: ((n[h + steps] + 1) ** 2 - n[h + steps] ** 2 if h + steps < 16 else 0) + (((n[h] - 1) ** 2 - n[h] ** 2) if h else 0) for h in range(17 - steps) if h == 0 or n[h]}
        assert options[packer.choose(size)] == min(options.values())
        packer.add(1, np.zeros(size, dtype=np.int32))
        assert [len(x) for x in packer.open[:-1]] == list(packer.level[:-1]) and packer.n_open == sum(map(len, packer.open))
        assert all(-(-f // 4) == k and f == sum(len(p[2]) for p in w) for k, x in enumerate(packer.open) for f, w in x)
    packer.close()
    fills = Counter()
    for p in packer.out:
        fills[p[5]] += p[2]
    assert all(n & (n - 1) == 0 for n in fills.values())


@pytest.mark.parametrize(("n", "share"), [(600, 0.6), (1000, 0.75), (5000, 0.9)])
def test_windows_close_by_placement(n, share):
    rng = np.random.default_rng(n)
    packer = packing.Packer(0)
    for k, size in enumerate(np.exp(rng.normal(6.3, 1.0, n)).astype(int) + 1):
        packer.add(k, np.zeros(size, dtype=np.int32))
    packer.close()
    paths = packer.paths
    assert sum(paths.values()) == sum(p[2] for p in packer.out) and paths["placed"] > share * (paths["placed"] + paths["joined"])
    assert len(packer.out) < 1.4 * n


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    scratch = Scratch(spark, "t")
    docs = read(spark, sf_dir, "documents")
    at = docs
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = scratch.keep(stage(spark, at, sf_dir), str(k))
        tables.append(at)
    assert all(t.columns == docs.columns for t in tables[:-1])
    ids = [Counter(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:])) and len(ids[0]) < docs.count()
    sets = [s for r in tables[1].collect() if (s := shingles(r.text))]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for a, b in combinations(sets, 2) if a & b)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, at.collect()))


def test_pipeline_against_second_forms(spark, docs, tmp_path):
    """Each stage on all that the one before kept, on a table with rows of every odd kind: by SQL, by brute force, and by the tokenizer."""
    import corpus_pipeline

    long = " ".join(f"{a}{b}" for a in "river stone bridge field cloud house road hill wind rain".split() for b in "abcdefgh")
    rows = [(None, long + ". No id, first."), (None, long + ". No id, second."), (5077, f"Before it. {long} After it all."), (5078, f"{long} changed"), (5079, "Kept. " + " ".join(f"{w} and more" for w in long.split())), (5079, "Other row of one id. " + " ".join(f"a {w}" for w in long.split()))]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).withColumns({"drop": F.lit("x"), "spans": F.lit(1), "__signals": F.lit(2), "times": F.lit(None).cast("int")}).write.parquet(f"{tmp_path}/documents.parquet")
    tables = [read(spark, str(tmp_path), "documents")]
    scratch = Scratch(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(scratch.keep(stage(spark, tables[-1], str(tmp_path)), str(k)))
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    paths = [f"{tmp_path}/documents.parquet/*.parquet", *(f"{scratch.path(str(k))}/*.parquet".replace("file:", "") for k in range(5))]

    def sql(k, query):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{paths[k]}')")
        cur = con.execute(query)
        return [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]

    def ids(k):
        return Counter(r.doc_id for r in tables[k].select("doc_id").collect())

    # quality rules
    assert ids(1) == Counter(r["doc_id"] for r in sql(0, quality_rules.sql()) if r["kept"])
    # near-dedup: rows without doc_id stay
    merged = {r["doc_id"]: r["kept"] for r in sql(1, minhash.SQL.replace("FROM documents)", "FROM documents WHERE doc_id IS NOT NULL AND doc_id <> 5079)", 1))}
    assert ids(2) == Counter({i: n for i, n in ids(1).items() if i is None or i == 5079 or merged[i]}) and sum(ids(2).values()) < sum(ids(1).values())
    # substring dedup
    before = [(r.doc_id, r.text) for r in tables[2].collect()]
    want = Counter()
    for (i, t), found in zip(before, brute_cuts(before)):
        kept, at = "", 0
        for a, b, *_ in sorted(found):
            kept, at = kept + t[at:a], b
        kept += (t or "")[at:]
        if not found or WORDS.search(kept):
            want[i, kept if found else t] += 1
    assert Counter((r.doc_id, r.text) for r in tables[3].collect()) == want and want != Counter(before)
    # mixing
    times = Counter()
    for r in sql(3, mixing.SQL):
        if r["size"]:
            times[r["doc_id"]] += r["taken"]
    taken = Counter()
    for r in tables[4].collect():
        taken[r.doc_id] += len(WORDS.findall(r.text or ""))
    assert +times == +taken
    # packing
    bpe = tokens.tokenizer(tokens.VOCABULARY)
    want = Counter()
    for r in tables[4].collect():
        ids_ = np.array([*bpe.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id] += len(ids_)
    got = Counter()
    for r in tables[5].collect():
        got[r.doc_id] += r.length
    assert got == want
    assert Counter(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()).total() > 0
