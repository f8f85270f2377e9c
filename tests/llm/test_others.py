"""Capture merge, URL rules, language, mixing, embeddings and packing."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import flow_mix, itq, langid, packing, url_rules, warc_merge
from amalgam.llm.queries import QUERIES
from tests.llm import cases


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        out = [(runs[r][i], r, i) for r, i in warc_merge.LoserTree(runs)]
        assert out == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))


def test_captures_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["b)/x", "a)/", "a)/y", None]), rng.choice([None, 5, 7, 9]), rng.choice([1, 2, None]), rng.choice("pq")) for _ in range(300)]
    df = spark.createDataFrame(rows, "url_key string, t long, page_id long, digest string").withColumn("captured_at", F.timestamp_seconds("t")).repartition(5)
    found = [(r["url_key"], r["captured_at"].timestamp() if r["captured_at"] else None, r["page_id"], r["capture_no"], r["n_captures"], r["changed"]) for r in warc_merge.merge_captures(df.withColumn("rank", F.lit(0)), run_rows=10).orderBy("global_rank").collect()]
    low = lambda x: -1 if x is None else x
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], low(r[1]), low(r[2]), r[3]))
    want = []
    for key, own in itertools.groupby(ordered, key=lambda r: r[0]):
        own = list(own)
        for i, r in enumerate(own):
            want.append((key, None if r[1] is None else float(r[1]), r[2], i + 1, len(own), i == 0 or own[i - 1][3] != r[3]))
    assert found == want
    assert warc_merge.merge_captures(df.limit(0)).count() == 0


def test_a_url_with_half_of_all_captures_is_split(spark):
    """Ranges are cut inside a history; what goes over a border is put together. Null digests, long and empty URLs, clashing columns."""
    rng = random.Random(31)
    rows = [(rng.choice(["hot", "hot", "hot", "", "b" * 50_000, f"u{rng.randrange(9)}", None]), rng.randrange(60), rng.randrange(4), rng.choice(["p", "q", None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "url_key string, t long, page_id long, digest string").withColumn("captured_at", F.timestamp_seconds("t")).repartition(6)
    for name in ("task", "run", "seq", "part", "place", "before"):
        df = df.withColumn(name, F.lit("own"))
    out = warc_merge.merge_captures(df, run_rows=40, range_rows=25)
    found = [(r["url_key"], int(r["captured_at"].timestamp()), r["page_id"], r["capture_no"], r["n_captures"], r["previous_at"] and int(r["previous_at"].timestamp()), r["changed"]) for r in out.orderBy("global_rank").collect()]
    assert [r["global_rank"] for r in out.orderBy("global_rank").collect()] == list(range(1, len(found) + 1))
    want = []
    for key, own in itertools.groupby(sorted((r for r in rows if r[0] is not None), key=lambda r: (*r[:3], r[3] or "")), key=lambda r: r[0]):
        own = list(own)
        want += [(key, r[1], r[2], i + 1, len(own), own[i - 1][1] if i else None, i == 0 or own[i - 1][3] != r[3]) for i, r in enumerate(own)]
    assert found == want


def test_url_keys(spark):
    urls = ["HTTP://user@www2.Ex.org:80/a/?b=2&a=1&utm_x=3#f", "ex.org", "http://ex.org/", None, ""]
    keys = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc_merge.url_key(F.col("u"))).collect()]
    assert keys == ["org,ex)/a?a=1&b=2", "org,ex)/", "org,ex)/", None, ")/"]


def brute_rules(labelled, support, confidence):
    n = len(labelled)
    items = sorted({t for tokens, _ in labelled for t in tokens})
    found = {}
    for size in (1, 2, 3):
        for c in itertools.combinations(items, size):
            has = [low for tokens, low in labelled if set(c) <= set(tokens)]
            if has and sum(has) >= support * n and sum(has) / len(has) >= confidence:
                found[c] = sum(has) / len(has)
    return {c: v for c, v in found.items() if not any(set(o) < set(c) and found[o] >= v for o in found)}


def test_rules_against_brute_force(spark):
    rng = random.Random(3)
    labelled = [(sorted(rng.sample(["h:a", "h:b", "p:c", "q:d"], rng.randrange(1, 4))), None) for _ in range(120)]
    labelled = [(t, rng.random() < (0.9 if {"h:a", "p:c"} <= set(t) else 0.3 if "h:b" in t else 0.1)) for t, _ in labelled]
    rules = url_rules.mine_rules(spark.createDataFrame(labelled, "tokens array<string>, low boolean"), min_support=0.02, min_count=1, min_confidence=0.4)
    found = {tuple(r["tokens"]): r["confidence"] for r in rules.collect()}
    want = brute_rules(labelled, 0.02, 0.4)
    assert set(found) == set(want) and all(found[c] == pytest.approx(want[c]) for c in want)
    keyed = spark.createDataFrame([("k1", ["h:a", "p:c", "q:z"]), ("k2", ["q:z"])], "key string, tokens array<string>")
    matched = {(r["key"], r["rule_id"]) for r in url_rules.match_rules(keyed, rules).collect()}
    assert matched == {("k1", " & ".join(c)) for c in want if set(c) <= {"h:a", "p:c", "q:z"}}


def test_url_filter_and_odd_cases(spark):
    pages = [(i, f"http://bad.org/p{i}" if i % 2 else f"http://good.org/q/{i}") for i in range(40)] + [(None, "http://bad.org/z"), (41, None), (42, ""), (42, "")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("key", F.lit("own")).withColumn("confidence", F.lit(0))
    for name in ("tokens", "low", "rule_id", "token", "rarest", "items"):
        df = df.withColumn(name, F.lit("own"))
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, None) for i in range(30)] + [(None, 0, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = url_rules.filter_urls(df, labels, min_confidence=0.8).collect()
    assert len(rows) == len(pages) and all(r["blocked"] == ("bad.org" in (r["url"] or "")) for r in rows)
    assert not any(r["blocked"] for r in url_rules.filter_urls(df, labels.limit(0)).collect()) and url_rules.filter_urls(df.limit(0), labels).count() == 0


def test_pages_are_blocked_by_rules_that_are_more_often_right(spark):
    low = {i for i in range(60) if i < 20 and i % 20 < 9 or 20 <= i < 40 and i % 20 < 11}
    pages = [(i, f"http://{('doubtful', 'bad', 'good')[i // 20]}.org/{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i not in low)) for i in range(60)], "doc_id long, quality int")
    rows = url_rules.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, min_confidence=0.4).collect()
    assert {r["page_id"] for r in rows if r["blocked"]} == set(range(20, 40)), "11 of 20 are enough, 9 of 20 aren't"
    assert all(r["best_rule"] == "h:doubtful" and r["confidence"] == 0.45 for r in rows if r["page_id"] < 20)


def test_planted_rules_through_the_query(spark, tmp_path):
    """Pages of two hosts are low only together with a path; the query finds these rules with its own parameters, and what brute force blocks."""
    rng = random.Random(21)
    pages, labels = [], []
    for i in range(1200):
        host, path = rng.choice(["spam", "news", "blog", "shop"]), rng.choice(["casino", "pills", "story", "about"])
        pages.append((i, f"https://www.{host}.com/{path}/{i}"))
        planted = (host, path) in (("spam", "casino"), ("shop", "pills"))
        if i % 3:
            labels.append((i, int(rng.random() < (0.1 if planted else 0.9))))
    pages += [(None, "https://www.spam.com/casino/x"), (5000, None), (5001, ""), (5002, "https://www.spam.com/casino/" + "y" * 20_000)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op3_url_rules"](spark, str(tmp_path)).collect()
    tokens = {r["u"]: set(r["t"]) for r in spark.createDataFrame([(u,) for _, u in pages if u], "u string").distinct().select("u", url_rules.url_tokens(F.col("u")).alias("t")).collect()}
    low, url_of = {i for i, q in labels if not q}, dict(pages)
    has = defaultdict(list)
    for i, _ in labels:
        for size in range(1, len(tokens[url_of[i]]) + 1):
            for c in itertools.combinations(sorted(tokens[url_of[i]]), size):
                has[c].append(i in low)
    least = max(url_rules.MIN_SUPPORT * len(labels), url_rules.MIN_COUNT)
    rules = {c: sum(v) / len(v) for c, v in has.items() if sum(v) >= least and sum(v) / len(v) >= url_rules.MIN_CONFIDENCE}
    rules = {c: v for c, v in rules.items() if not any(set(o) < set(c) and rules[o] >= v for o in rules)}
    assert len(rows) == len(pages)
    for r in rows:
        own = sorted((-v, " & ".join(c)) for c, v in rules.items() if r["url"] and set(c) <= tokens[r["url"]])
        assert r["n_rules"] == len(own) and r["best_rule"] == (own[0][1] if own else None) and r["blocked"] == (bool(own) and -own[0][0] > 0.5)
    blocked = {r["page_id"] for r in rows if r["blocked"]}
    planted = {i for i, u in pages if u and ("spam.com/casino" in u or "shop.com/pills" in u)}
    assert blocked == planted and len(planted) > 100


def test_language_on_held_out_documents(spark):
    rng = random.Random(4)
    vocab = {"xx": ["kara", "tulo", "mina", "sorek"], "yy": ["thwing", "brough", "shrent", "wyld"], "zz": ["oiseau", "eaux", "cieux", "aieul"]}
    make = lambda lang: " ".join(rng.choice(vocab[lang]) for _ in range(30))
    train = cases.table(spark, [(i, make(lang), lang) for i, lang in enumerate(list(vocab) * 20)])
    profiles = langid.train_profiles(train)
    fresh = [(i, make(lang), lang) for i, lang in enumerate(list(vocab) * 20)]
    found = {r["doc_id"]: r for r in langid.identify_languages(cases.table(spark, fresh), profiles).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in fresh)
    grams = langid.Ngrams(langid.DIM, langid.SEED)
    vectors = {}
    for lang in vocab:
        total = sum(grams.bundle(*np.unique(langid.ngram_codes(r["text"]), return_counts=True)) for r in train.filter(F.col("lang") == lang).collect())
        vectors[lang] = total / np.linalg.norm(total)
    v = grams.bundle(*np.unique(langid.ngram_codes(fresh[0][1]), return_counts=True))
    cosines = sorted((float(vectors[x] @ v / np.linalg.norm(v)) for x in vocab), reverse=True)
    assert found[0]["score"] == pytest.approx(cosines[0], abs=1e-6) and found[0]["margin"] == pytest.approx(cosines[0] - cosines[1], abs=1e-6)
    odd = langid.identify_languages(cases.odd(spark), profiles)
    assert odd.count() == 12 and {r["lang_pred"] for r in odd.filter("doc_id in (1, 2, 3, 4)").collect()} == {None}
    none = langid.train_profiles(cases.empty(spark))
    assert langid.identify_languages(cases.odd(spark), none).filter("lang_pred is not null").count() == 0


def brute_flow(tokens, members, quotas, costs):
    """Least cost of the largest flow, by successive shortest paths over single tokens."""
    nodes = ["s", *[("p", i) for i in range(len(tokens))], *[("c", i) for i in range(len(quotas))], "t"]
    arcs = []
    for i, n in enumerate(tokens):
        arcs += [["s", ("p", i), n, c] for c in costs] + [[("p", i), ("c", j), 10**6, 0] for j in members[i]]
    arcs += [[("c", j), "t", q, 0] for j, q in enumerate(quotas)]
    edges = [e for a, b, r, c in arcs for e in ([a, b, r, c], [b, a, 0, -c])]
    amount = cost = 0
    while True:
        dist, via = dict.fromkeys(nodes, float("inf")), {}
        dist["s"] = 0
        for _ in nodes:
            for k, (a, b, r, c) in enumerate(edges):
                if r and dist[a] + c < dist[b]:
                    dist[b], via[b] = dist[a] + c, k
        if dist["t"] == float("inf"):
            return amount, cost
        x = "t"
        while x != "s":
            k = via[x]
            edges[k][2] -= 1
            edges[k ^ 1][2] += 1
            x = edges[k][0]
        amount, cost = amount + 1, cost + dist["t"]


@pytest.mark.parametrize("seed", range(5))
def test_flow_against_brute_force(seed):
    rng = random.Random(seed)
    tokens = [rng.randrange(1, 5) for _ in range(4)]
    members = [sorted(rng.sample(range(3), rng.randrange(1, 4))) for _ in tokens]
    quotas = [rng.randrange(0, 12) for _ in range(3)]
    flow = flow_mix.MixFlow(tokens, members, quotas, (0, 1, 3))
    assert (flow.amount, flow.cost) == brute_flow(tokens, members, quotas, (0, 1, 3))
    taken = Counter()
    for p, c, n in flow.flows():
        assert c in members[p]
        taken[c] += n
    assert all(taken[c] <= q for c, q in enumerate(quotas))


def test_mix_meets_quotas(spark):
    rng = random.Random(5)
    docs = [(i, cases.words(rng, rng.randrange(5, 60)), rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s0", "s1"])) for i in range(400)]
    rows = flow_mix.mix(cases.table(spark, docs), {"source:s0": 1, "source:s1": 1}, budget=1.0).collect()
    total = sum(len(d[1].split()) for d in docs)
    by = defaultdict(int)
    for r in rows:
        by[r["component"]] += r["n_tokens"]
        assert r["component"] == f"source:{docs[r['doc_id']][3]}"
    assert all(abs(by[c] - total / 2) < 0.02 * total for c in by) and max(r["epoch"] for r in rows if r["component"] == "source:s1") >= 1
    again = flow_mix.mix(cases.table(spark, docs[::-1]).repartition(7), {"source:s0": 1, "source:s1": 1}).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sum(flow_mix.quotas({"a": 5, "b": 7, "c": 1}, 11).values()) == 11


def test_default_mix_of_a_hot_source(spark):
    rng = random.Random(15)
    docs = [(i, cases.words(rng, 50), rng.choice(["en", "de"]), rng.choices(["a", "b", "c"], [90, 8, 2])[0]) for i in range(1000)]
    rows = flow_mix.mix(cases.table(spark, docs)).collect()
    have, took, langs = Counter(), Counter(), Counter()
    for d in docs:
        have[d[3]] += 50
    for r in rows:
        took[docs[r["doc_id"]][3]] += r["n_tokens"]
        langs[docs[r["doc_id"]][2]] += r["n_tokens"]
        assert r["component"] == f"source:{docs[r['doc_id']][3]}"
    shares = {s: n**flow_mix.ALPHA for s, n in have.items()}
    assert all(abs(took[s] - 50_000 * shares[s] / sum(shares.values())) <= 200 for s in have), (have, took)
    assert took["a"] < have["a"] and took["c"] > have["c"] and max(r["epoch"] for r in rows) >= 1
    assert abs(langs["en"] - langs["de"]) < 5_000, "the part that is left out isn't one language"
    no_source = flow_mix.mix(cases.table(spark, [(1, "a b", "en", None)])).collect()
    assert [(r["doc_id"], r["component"]) for r in no_source] == [(1, "other:")]
    by_lang = flow_mix.mix(cases.table(spark, docs), {"lang:en": 3, "lang:de": 1}).collect()
    assert {r["component"] for r in by_lang} == {"lang:en", "lang:de"}


@pytest.mark.parametrize("weights", [None, {"source:s0": 1, "source:s1": 3}])
def test_selection_against_brute_force(spark, weights):
    """Every document taken, and how often, from the flow over patterns: laid end to end in the order of the hash, cut at the flow's amounts."""
    rng = random.Random(25)
    docs = [(i, cases.words(rng, rng.randrange(3, 30)), "en", rng.choice(["s0", "s0", "s1", None])) for i in range(150)]
    docs += [(500 + i, docs[i][1], "en", "s1") for i in range(0, 60, 3)] + [(None, cases.words(rng, 12), "en", "s1"), (None, docs[1][1], "en", "s0")]
    rows = flow_mix.mix(cases.table(spark, docs), weights).collect()
    units = {}
    for i, text, _, source in docs:
        u = units.setdefault(text, [[], set()])
        u[0] += [i] if i is not None else []
        u[1] |= {f"source:{source}"} if source else set()
    hashed = {r["text"]: (r["h"], r["p"]) for r in cases.table(spark, docs).select("text", F.xxhash64(F.lit(flow_mix.SEED), F.unhex(F.md5("text"))).alias("p"), F.xxhash64(F.lit(flow_mix.SEED), "doc_id").alias("h")).collect()}
    ids = {r["doc_id"]: r["h"] for r in cases.table(spark, docs).filter("doc_id is not null").select("doc_id", F.xxhash64(F.lit(flow_mix.SEED), "doc_id").alias("h")).collect()}
    patterns = defaultdict(list)
    for text, (own, sources) in units.items():
        doc = min(own) if own else None
        patterns[tuple(sorted(sources)) or ("other:",)].append((hashed[text][1] if doc is None else ids[doc], str(doc), doc, len(text.split())))
    names = sorted(patterns, key="\x1f".join)
    components = sorted({c for p in names for c in p})
    tokens = [sum(x[3] for x in patterns[p]) for p in names]
    quota = flow_mix.quotas({c: sum(t for p, t in zip(names, tokens, strict=True) if c in p) for c in components}, sum(tokens), weights)
    flow = flow_mix.MixFlow(tokens, [[components.index(c) for c in p] for p in names], [quota[c] for c in components])
    want = Counter()
    for k, p in enumerate(names):
        shares = [components[c] for q, c, n in flow.flows() if q == k for _ in range(n)]
        at = 0
        for epoch in range(-(-len(shares) // tokens[k])):
            for _, _, doc, n in sorted(patterns[p], key=lambda x: x[:2]):
                middle = at + n / 2
                if middle < len(shares):
                    want[doc, epoch, shares[int(middle)], n] += 1
                at += n
    assert Counter((r["doc_id"], r["epoch"], r["component"], r["n_tokens"]) for r in rows) == want
    taken = Counter((r["doc_id"], len(r["text"].split())) for r in flow_mix.take_mixed(cases.table(spark, docs), weights).collect())
    assert taken == sum((Counter({(doc, n): k}) for (doc, _, _, n), k in want.items()), Counter())


def test_every_pattern_keeps_all_its_components(spark):
    docs = [(i, t, "en", s) for i, (t, s) in enumerate([("a b c", "x"), ("a b c", "y"), ("d e", "y"), ("d e", "z"), ("f", "z")])]
    rows = flow_mix.mix(cases.table(spark, docs)).collect()
    assert {(r["doc_id"], r["epoch"], r["component"]) for r in rows} == {(0, 0, "source:x"), (2, 0, "source:z"), (4, 0, "source:z")}


def test_more_patterns_than_were_once_kept(spark):
    """Each text is also in a source that takes nothing; it has to be taken by its other source, which has room for it alone."""
    n = 20_100
    docs = [(i, f"w{i}", "en", s) for i in range(n) for s in ("a", f"b{i}")]
    rows = flow_mix.mix(cases.table(spark, docs), {f"source:b{i}": 1 for i in range(n)}).collect()
    assert sorted((r["doc_id"], r["epoch"], r["component"]) for r in rows) == [(i, 0, f"source:b{i}") for i in range(n)]


def test_mix_odd_cases(spark):
    odd = cases.odd(spark)
    taken = flow_mix.take_mixed(odd)
    assert taken.columns == odd.columns and not {1, 2, 3} & {r["doc_id"] for r in taken.collect()}
    cases.own_columns_stay(taken)
    assert flow_mix.mix(cases.empty(spark)).count() == 0 and flow_mix.take_mixed(cases.empty(spark)).count() == 0
    shared = flow_mix.mix(cases.table(spark, [(1, "a b", "en", "s0"), (2, "a b", "en", "s1"), (3, "c d", None, None)])).collect()
    assert {r["doc_id"] for r in shared} <= {1, 3}


def planted_vectors(dim, common, seed, n=600, at=None):
    """Random unit vectors about a ``common`` direction, others near half of them, and three copies at twice the length."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)) + common * np.sqrt(dim) * np.eye(dim)[0]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = []
    for x in base[: n // 2]:
        z = rng.standard_normal(dim)
        z -= z @ x * x
        c = at or rng.uniform(0.9, 0.99)
        near.append(c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    return np.concatenate([base, near, base[:3] * 2]).astype(np.float32)


@pytest.mark.parametrize(("dim", "common"), [(16, 0.0), (32, 0.0), (64, 0.0), (64, 1.2)])
def test_near_embeddings_through_the_query(spark, tmp_path, dim, common):
    vectors = planted_vectors(dim, common, 6)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: r["group_id"] for r in QUERIES["op6_itq_near_embeddings"](spark, str(tmp_path)).collect()}
    pairs = itq.brute_force_pairs(vectors.astype(np.float64))
    assert len(pairs) >= 300 and sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs) and all(found[900 + i] == found[i] for i in range(3))
    exact = cases.groups_of(range(len(vectors)), pairs)
    assert all(exact[i] == exact[found[i]] for i in found), "every pair is verified"


def test_candidates_of_a_vector_stay_few():
    """Pairs at the threshold meet, and unrelated ones less and less often as the table grows."""
    share = []
    for n in (2000, 16_000):
        x = planted_vectors(64, 0.0, 3, n, at=0.9)[: n + n // 2].astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = itq.learn(x[: itq.SAMPLE], len(x), 0.9)
        code = q.bits(x)
        keys, sketch = q.keys(code), q.sketch(code)
        met = (keys[: n // 2] == keys[n:]).any(1)
        far = np.bitwise_count((sketch[: n // 2] ^ sketch[n:]).view(np.uint64)).sum(1)
        assert (met & (far <= q.radius)).mean() >= 0.99
        assert (np.bitwise_count((sketch[: n // 2] ^ sketch[n // 2 : n]).view(np.uint64)).sum(1) <= q.radius).mean() < 0.01
        _, sizes = np.unique(keys, return_counts=True)
        share.append((sizes * (sizes - 1) / 2).sum() / (len(x) ** 2 / 2))
    assert share[1] < share[0] / 3, share


def test_rotation_lowers_the_quantisation_error():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8)) @ rng.standard_normal((8, 8))

    def error(rounds):
        v = x @ itq.rotations(x, 1, rounds, np.random.default_rng(1))
        return np.linalg.norm(np.where(v > 0, 1, -1) - v)

    assert error(8) < error(0)
    y, z = itq.simulated_pairs(x / np.linalg.norm(x, axis=1, keepdims=True), 0.9, rng)
    assert np.allclose((y * z).sum(1), 0.9) and np.allclose(np.linalg.norm(z, axis=1), 1)


@pytest.mark.parametrize("crowd_size", [512, 20])
def test_a_crowd_of_near_vectors_is_one_group(spark, monkeypatch, crowd_size):
    """A third of all vectors lie about one direction, and are one another's neighbours through their least one or a chain."""
    rng = np.random.default_rng(12)
    crowd = np.eye(32)[0] + 0.02 * rng.standard_normal((150, 32))
    vectors = np.concatenate([rng.standard_normal((300, 32)), crowd])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(itq, "CROWD", crowd_size)
    found = {r["vec_id"]: r["group_id"] for r in itq.near_embeddings(df).collect()}
    assert {found[i] for i in range(300, 450)} == {300} and all(found[i] == i for i in range(300)) and found[1000] == 1000


def test_ties_of_vectors_and_languages(spark):
    """Two vectors at the threshold are near; of equally near languages the first in order counts, and the margin is 0."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.9, math.sqrt(0.19), 0.0]), (3, [0.89, 0.0, math.sqrt(1 - 0.89**2)])]
    found = {r["vec_id"]: r["group_id"] for r in itq.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    same = cases.table(spark, [(1, "ein kleines haus", "yy"), (2, "ein kleines haus", "xx"), (3, "une petite maison", "zz")])
    row = langid.identify_languages(same, langid.train_profiles(same)).filter("doc_id = 1").first()
    assert (row["lang_pred"], row["margin"]) == ("xx", 0.0)


def test_embeddings_odd_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("own")).withColumn("v", F.lit(1))
    found = {r["vec_id"]: r["group_id"] for r in itq.near_embeddings(df).collect()}
    assert set(found) == set(range(1, 12)) and found[7] == 5 and all(found[i] == i for i in (1, 2, 3, 4, 5, 8, 9, 10, 11))
    assert itq.near_embeddings(df.limit(0)).count() == 0


def test_each_length_of_vectors_is_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), *((10 + i, [float(i == j % 3) for j in range(3)]) for i in range(3)), (13, [0.0, 0.0, 5.0])]
    found = {r["vec_id"]: r["group_id"] for r in itq.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 10: 10, 11: 11, 12: 12, 13: 12}


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_naive_first_fit(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 101) for _ in range(200)), reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 100)
    assert bins.tolist() == packing.naive_first_fit(sizes, 100)
    room = defaultdict(int)
    for size, b, o in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        assert o == room[b]
        room[b] += size
    assert max(room.values()) <= 100


def test_packing_covers_every_token(spark):
    rng = random.Random(8)
    docs = [(i, cases.words(rng, rng.choice([3, 50, 99, 100, 101, 250]))) for i in range(120)]
    rows = packing.pack_documents(cases.table(spark, docs), capacity=100, group_docs=30).collect()
    used = defaultdict(int)
    tokens = Counter()
    for r in rows:
        used[r["pack_group"], r["bin"]] += r["n_tokens"]
        tokens[r["doc_id"]] += r["n_tokens"]
    assert max(used.values()) <= 100 and tokens == Counter({i: len(t.split()) for i, t in docs}) and len({r["pack_group"] for r in rows}) == 4
    again = packing.pack_documents(cases.table(spark, docs * 3 + docs[:5] * 40).repartition(5), capacity=100, group_docs=10).collect()
    assert len({(r["doc_id"], r["epoch"], r["piece"]) for r in again}) == len(again) and Counter(r["doc_id"] for r in again if not r["piece"]) == Counter({i: 43 if i < 5 else 3 for i, _ in docs})
    beside = Counter((r["doc_id"], r["pack_group"]) for r in again if not r["piece"])
    assert max(beside.values()) == 1, "no group has two epochs of a document"
    odd = packing.pack_documents(cases.odd(spark)).collect()
    assert {r["doc_id"] for r in odd} == {None, 4, 5, 6, 7, 8, 9, 10} and sum(r["n_tokens"] for r in odd if r["doc_id"] == 5) == 30_000
    assert packing.pack_documents(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(cases.empty(spark), capacity=0)
