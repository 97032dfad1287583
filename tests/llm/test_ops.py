"""The corpus operators against brute force, round trips and held-out labels, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelane.llm import queries
from tidelane.llm.common import join_frequent, labelled_sample
from tidelane.llm.components import _forests, components, forest
from tidelane.llm.decontaminate import leaks
from tidelane.llm.html import extract, main_text
from tidelane.llm.interleave import interleaved, shard_digest
from tidelane.llm.minhash import confirmed, near_duplicates
from tidelane.llm.mixing import mixture
from tidelane.llm.pii import bootstrap, personal_data, personal_digest
from tidelane.llm.quality import FEATURES, fit, quality, statistics
from tidelane.llm.tokencount import document_counts, encoder, separator_scan
from tidelane.llm.topk import Side, best_rows, levels, segment_statistics, top_k
from tidelane.llm.toxicity import segments, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s0", 0),
    (3, "one", "en", "s1", 3),
    (3, "one", "en", "s1", 3),
    (None, "word " * 30, "en", "s1", 5),
    (4, "word " * 30, None, "s1", 5),
    (5, "x y\tzé \U0001f600 " * 4000, "de", "s2", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("Score", F.lit("mine"))


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


# 1 ---------------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in enumerate(BASE.values()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_equals_regular_expressions(spark, docs):
    hard = [
        "a@b.c_d@e.f x@y",
        "1.2.3.4.5.6.7.8 0255.1.1.256 999.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112",
        "+1 (017) 555-7713 +49 30 12",
        "\U0001f600 a@b.co \x01 c@d.co",
        "1 " * 3000 + "a@b.cd",
        "aaaa" * 5000 + "@",
        "é a.b@x-y.z.",
        "5" * 19 + " 79927398713",
        "+1.+1234567890-",
    ]
    made = spark.createDataFrame([(1000000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(made)
    got = rows_of(personal_digest(personal_data(both)))
    for r in both.collect():
        s = base_spans(r.text)
        text = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in s)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r.text[:80]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x[1] == k for x in s) for k in range(4)]


def test_pii_contexts_find_more(spark):
    # cards that fail the checksum, in the context that valid ones stand in
    valid = [x for x in (f"41111111111{i:05d}" for i in range(1000)) if luhn(x)][:12]
    other = ["4111111111111112", "5500005555555550"]
    rows = [(i, f"word number {i} my card is {c} thanks a lot") for i, c in enumerate(valid + other)] + [(50, "page 12 of 30 is blank 4111111111111113 here")]
    got = rows_of(personal_digest(personal_data(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert [got[i].n_found for i in range(12)] == [0] * 12 and [got[i].n_found for i in (12, 13)] == [1, 1] and got[50].n_found == 0
    assert got[12].spans.startswith("card:") and got[12].n_card == 0
    none = personal_digest(personal_data(spark.createDataFrame([], "doc_id long, text string")))
    assert none.count() == 0


def test_pii_contexts_find_numbers_of_several_words(spark):
    # phones of too few digits and cards that fail the checksum, among valid ones with spaces; 40 ends a text with digits around
    phones = [f"+1 (743) 555-38{i:02d}" for i in range(6)]
    cards = [f"{x[:4]} {x[4:8]} {x[8:12]} {x[12:]}" for x in (f"41111111111{i:05d}" for i in range(200)) if luhn(x)][:6]
    text = [f"you may call {p} after lunch" for p in phones] + [f"my card is {c} thanks" for c in cards]
    text += ["you may call +1 (743) 555-3 after lunch", "my card is 4111 1111 1111 1112 thanks", "row 7 call +1 (743) 555-3 today"]
    text += [f"room 12 {p} late" for p in phones] + ["room 12 +1 (743) 55-3 late", "room 13 +1 (743) 55-4 late"]
    got = rows_of(personal_digest(personal_data(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"))))
    assert [got[i].n_found for i in range(12)] == [0] * 12
    assert (got[12].spans, got[13].spans, got[14].spans) == ("phone:13:27", "card:11:30", "")
    assert [got[i].n_found for i in range(15, 21)] == [0] * 6 and got[21].spans == "phone:8:21" and got[22].spans == ""


def test_pii_contexts_follow_chains(spark):
    numbers = [f"41111111111{i:05d}" for i in range(1200)]
    valid, other = [x for x in numbers if luhn(x)][:90], [x for x in numbers if not luhn(x)][:27]
    text = [f"card is {c} ok" for c in valid] + [f"card is {c} now" for c in other[:21]] + [f"pin is {c} now" for c in other[21:26]] + [f"pin is {other[26]} later"]
    got = rows_of(personal_digest(personal_data(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"))))
    assert [got[i].n_found for i in range(len(text))] == [0] * 90 + [1] * 27


def brute_bootstrap(tokens, support, confidence, least=0.5):
    """Rounds over the pattern-instance graph in plain Python, on instances of one word each."""
    forms = collections.defaultdict(collections.Counter)
    digits = collections.defaultdict(list)
    for t in tokens:
        if t["kind"] >= 0:
            forms[t["shape"]][t["kind"]] += 1
            digits[t["shape"], t["kind"]].append(t["digits"])

    def patterns(t):
        word = t["left"].split(" ")[-1]
        return {"L": t["left"], "l": word, "r": t["right"], "B": f"{word} _ {t['right']}" if word and t["right"] else ""}

    def kind_of(t):
        ok = [(n, -k) for k, n in forms[t["shape"]].items() if min(digits[t["shape"], k]) <= 2 * t["digits"] and t["digits"] <= 2 * max(digits[t["shape"], k])]
        return -max(ok)[1] if ok else None

    found = {}
    while True:
        seen = collections.defaultdict(dict)
        for i, t in enumerate(tokens):
            for side, p in patterns(t).items():
                if p:
                    seen[side, p][t["value"]] = seen[side, p].get(t["value"], False) or t["kind"] >= 0 or i in found
        score = {k: sum(v.values()) / len(v) for k, v in seen.items() if sum(v.values()) >= support and sum(v.values()) >= least * len(v)}
        new = {}
        for i, t in enumerate(tokens):
            if t["kind"] < 0 and i not in found and kind_of(t) is not None:
                got = {side: score.get((side, p)) for side, p in patterns(t).items() if p}
                best = max(got.get("L") or 0, got.get("B") or 0)
                if got.get("l") and got.get("r"):
                    best = max(best, 1 - (1 - got["l"]) * (1 - got["r"]))
                if best >= confidence:
                    new[i] = kind_of(t)
        if not new:
            return found
        found |= new


def test_pii_rounds_equal_brute_force(spark):
    rng = random.Random(4)
    tokens = []
    for i in range(900):
        word = lambda: rng.choice(["a", "b", "c", "d", "e", "f", ""])
        left = " ".join(x for x in (word(), word()) if x)
        sure = left[-1:] in ("a", "b", "c")
        kind = rng.choice([0, 1, 2]) if sure and rng.random() < 0.85 else -1
        shape = rng.choice(["9", "a9"]) if kind != 1 else "9.9"
        tokens.append(
            {
                "row": i,
                "start": 5,
                "end": 9,
                "left": left,
                "right": word(),
                "shape": shape if kind >= 0 else rng.choice(["9", "a9", "9.9", "z"]),
                "digits": rng.randint(4, 30),
                "value": rng.randrange(600),
                "kind": kind,
                "longest": True,
            }
        )
    df = spark.createDataFrame(
        [tuple(t.values()) for t in tokens],
        "row long, start int, end int, left string, right string, shape string, digits int, value long, kind int, longest boolean",
    )
    want = brute_bootstrap(tokens, 3, 0.8)
    got = {r.row: r.kind for r in bootstrap(df, 3, 0.8).collect()}
    assert got == want and 20 <= len(want) < sum(t["kind"] < 0 for t in tokens)


def test_pii_contexts_have_no_length_limit(spark):
    valid = [x for x in (f"41111111111{i:05d}" for i in range(1000)) if luhn(x)][:12]
    long = "w" * 5000
    rows = [(i, f"my {long} {' ' * 3000}{c} thanks a lot") for i, c in enumerate([*valid, "4111111111111112"])]
    got = rows_of(personal_digest(personal_data(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got[12].n_found == 1 and got[0].n_found == 0
    other = [(i, f"my {long}{i} {' ' * 3000}{c} thanks{i} a lot") for i, c in enumerate([*valid, "4111111111111112"])]
    assert rows_of(personal_digest(personal_data(spark.createDataFrame(other, "doc_id long, text string"))))[12].n_found == 0


def test_pii_odd_rows(spark, odd):
    rows = [
        (7, "a@b.co", "en", "s", 1),
        (7, "a@b.co", "en", "s", 1),
        (7, "c@d.co 1.2.3.4", "en", "s", 1),
        (None, "+1 (017) 555-7713", "en", "s", 1),
        (8, None, None, None, None),
    ]
    both = odd.unionByName(spark.createDataFrame(rows, DOCS).withColumn("Score", F.lit("x"))).withColumn("Kind", F.lit(1)).withColumn("t", F.lit("a@b.co"))
    out = personal_digest(personal_data(both)).collect()
    assert len(out) == len(ODD) + len(rows)
    assert sorted(r.n_email for r in out if r.doc_id == 7) == [1, 1, 1] and [r.n_phone for r in out if r.doc_id is None and r.n_phone] == [1]
    assert all(r.spans == "" and r.n_found == 0 for r in out if r.doc_id in (1, 2, 8))


def test_pii_contexts_find_planted_numbers(spark):
    """On a whole table: what contexts add has the form of a card, and texts without digits get nothing."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    added = personal_data(d).where("size(more) > 0").select("doc_id", "more").join(d.select("doc_id", "text"), "doc_id").collect()
    spans = [r.text[m.start : m.end] for r in added for m in r.more]
    assert len(spans) >= 5 and all(re.fullmatch(r"[0-9]{16}", x) and not luhn(x) for x in spans)


# 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"chunk_numbers": 300, "first_rows": 20}])
def test_top_k_equals_brute_force(spark, limits):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 64)).astype(np.float32)
    x[40:80] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (300, None),
        (301, [1.0, None]),
        (302, [float("nan")] * 64),
        (320, [1.0, 2.0]),
        (340, [0.5, 0.5]),
        (360, []),
    ]
    rows += [(None, [1.0] * 64), (380, [1e30] * 64), (400, [float("inf")] * 64)]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Score", F.lit(1)).withColumn("dim", F.lit("x"))
    for r in top_k(df, 20, 20, **limits).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(64 * x.astype(float)).astype(int)
    for i in range(0, 300, 20):
        s = q @ q[i]
        want = sorted((-int(s[j]), j) for j in range(300) if j != i)[:20]
        assert got[i] == [(j, -v) for v, j in want]
    assert got[320] == [(340, 6144)] and got[340] == [(320, 6144)] and set(got) == {*range(0, 300, 20), 320, 340}
    assert top_k(df.where("false"), 20, 20).count() == 0


def test_top_k_of_repeated_and_large_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1e6, 2.0]), (3, [1e6, 2.0]), (4, [-1e7, 3.0]), (60, [2e7, 1.0]), (80, [3e7, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 2).collect()]
    want, rows = [], rows[:-1]  # the last one's scores can leave 63 bits
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:2]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    assert levels(64) == [4, 8, 16] and levels(2) == []
    for level in levels(64):
        assert (segment_statistics(a, level) @ segment_statistics(b, level).T >= a @ b.T - 1e-9).all()
    q, x = Side(np.full(50, -1), (a * 50).astype(int)), Side(np.arange(60), (b * 50).astype(int))
    qi, xi, s = best_rows(q, 0, 50, x, 5, np.full(50, -np.inf))
    for i in range(50):
        best = set(np.argsort(-(x.x @ q.x[i]))[:5])
        assert best <= set(xi[qi == i])
    assert (s == (q.x[qi] * x.x[xi]).sum(axis=1)).all()
    far = Side(np.arange(60), (b * 50).astype(int) - 10**4 * np.sign(q.x[0]))
    assert not len(best_rows(q, 0, 1, far, 5, np.array([0.0]))[0])  # the box alone is below the floor


# 3 ---------------------------------------------------------------------------------------------------------------


def all_maximal(s, a, b):
    best = None
    for i in range(a, b):
        t = 0.0
        for j in range(i, b):
            t += s[j]
            if t > 0 and (best is None or t > best[0] + 1e-12):
                best = (t, i, j + 1)
    return all_maximal(s, a, best[1]) + [best[1:]] + all_maximal(s, best[2], b) if best else []


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.choice([-3.1, -2.3, -1.7, 1.13, 2.77, 3.91]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [x[:2] for x in segments(s)] == all_maximal(s, 0, len(s))


def test_log_odds_equal_a_written_model(spark, docs):
    """Word scores recomputed from counts of strings: Dirichlet prior, log-odds, errors and shrinkage."""
    from tidelane.llm import toxicity as T

    rows = [(r.text, r.doc_id % 3 == 0) for r in docs.limit(120).collect()]
    rows = [(t + " vile vilest " * 3 if y else t, int(y)) for t, y in rows]
    model = T.log_odds(spark.createDataFrame(rows, "text string, y int"))
    count = {0: collections.Counter(), 1: collections.Counter()}
    for t, y in rows:
        words = re.findall(rb"[a-z'\x80-\xff]+", t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
        count[y].update({(0, w) for w in words} | {(k, w[:k]) for w in words for k in T.STEMS if len(w) > k})
    keys = set(count[0]) | set(count[1])
    prior = {w: T.PRIOR_FLAT + T.PRIOR_SHARE * (count[0][w] + count[1][w]) for w in keys}
    a0, n = sum(prior.values()), [sum(count[y].values()) for y in (0, 1)]
    want = []
    for w in keys:
        odds = [np.log((count[y][w] + prior[w]) / (n[y] + a0 - count[y][w] - prior[w])) for y in (0, 1)]
        error = (1 / (count[0][w] + prior[w]) + 1 / (count[1][w] + prior[w])) ** 0.5
        z = (odds[1] - odds[0]) / error
        if abs(z) > T.SURE:
            want.append((odds[1] - odds[0]) * (1 - (T.SURE / z) ** 2))
    assert len(want) >= 2 and np.allclose(sorted(model.gain), sorted(want))
    best = next(iter(T.texts_gains(model, pa.array(["so vile a day"]))))
    assert len(best) == 4 and best[1] > 0 and best[0] == best[2] == 0


@pytest.fixture(scope="module")
def big(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held_out(scored, labels, label):
    p = scored.select("doc_id", "predicted").join(labels, "doc_id").toPandas()
    p = p[[zlib.crc32(str(i).encode()) % 5 == 0 for i in p["doc_id"]]]
    return (p["predicted"] == p[label]).mean()


def test_toxicity_held_out(big):
    out = toxicity(*big)
    assert out.count() == big[0].count()
    assert held_out(out, big[1], "toxic") >= 0.9


def test_toxicity_odd_rows(spark, odd, big):
    out = toxicity(odd, big[1]).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity(empty, big[1]).count() == 0
    assert toxicity(odd, big[1].where("false")).count() == len(ODD)


# 4, 7 ------------------------------------------------------------------------------------------------------------


def test_mixture_fills_and_redistributes(spark):
    rows = [(i, "w " * 10, "en" if i % 3 else "de", f"s{i % 5}", 0) for i in range(600)] + [(None, "", None, None, 0), (7000, None, "en", "s1", 0)]
    d = spark.createDataFrame(rows, DOCS)
    out = mixture(d, {"d0": 1, "d1": 1, "d2": 1, "d3": 1}, {"en": 1, "de": 1}, share=(1, 2), parts=16)
    p = out.toPandas()
    assert not p.duplicated(["doc_id", "epoch"]).any() and p["epoch"].max() == 0
    leaf = p.groupby(["domain", "lang", "source"], dropna=False)["n_tokens"].sum()
    assert abs(p["n_tokens"].sum() - 3000) <= 10 * len(leaf)
    # d0 has s0 and s4; every domain gets a quarter, German shortage (40 rows a source) goes to English first
    by = p.groupby("domain")["n_tokens"].sum()
    assert by["d1"] == by["d2"] == by["d3"] and abs(by["d0"] - 750) <= 40
    lang = p[p.domain == "d1"].groupby("lang")["n_tokens"].sum()
    assert lang["de"] >= 370 and lang["en"] >= 370
    twice = mixture(d, {}, {}, total=9000, max_epochs=2, parts=16).toPandas()
    assert set(twice["epoch"]) == {0, 1} and abs(twice["n_tokens"].sum() - 9000) <= 10 * len(leaf)
    assert mixture(d.where("false"), {}, {}).count() == 0


def test_water_filling_equals_brute_force(spark):
    from tidelane.llm.mixing import leaf_budgets

    rng = random.Random(1)
    leaves = [(f"d{rng.randint(0, 2)}", f"l{j}", f"s{k}", rng.randint(0, 100)) for j in range(3) for k in range(4)]
    leaves = list({x[:3]: x for x in leaves}.values())
    got = {
        tuple(r[:3]): r.got for r in leaf_budgets(
            spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"),
            300,
            (1, 1),
            {},
            {},
            {},
            1,
        ).collect()
    }
    assert sum(got.values()) == min(300, sum(x[3] for x in leaves)) and all(got[x[:3]] <= x[3] for x in leaves)
    for d in {x[0] for x in leaves}:  # siblings that are not full have equal parts, within rounding
        for lang in {x[1] for x in leaves if x[0] == d}:
            part = [(got[x[:3]], x[3]) for x in leaves if x[:2] == (d, lang)]
            open_ = [g for g, cap in part if g < cap]
            assert not open_ or max(open_) - min(open_) <= 4
            assert all(g <= max(open_) for g, cap in part if g == cap) if open_ else True


def test_shards_match_the_mixture(spark, docs, odd):
    out = shard_digest(docs, 7).toPandas()
    n = len(out)
    assert n == docs.count() and set(out["law"]) == {"rows"}
    sizes = out.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    for s, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    full = out.merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    table = full.groupby(["source", "shard"]).size().unstack(fill_value=0)
    want = table.sum(axis=1) / 7
    assert (table.sub(want, axis=0).abs() < 2).all().all()
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 8 == s for t, c, s in zip(full["text"], full["text_crc32"], full["size"], strict=True))
    o = shard_digest(odd, 3).toPandas()
    assert len(o) == len(ODD) and o["size"].min() == 8 and shard_digest(docs.where("false"), 3).count() == 0
    # the same law by brute force
    md5 = lambda x: hashlib.md5(f"0:{x}".encode()).hexdigest()
    src, text = collections.defaultdict(list), {}
    for r in docs.select("doc_id", "source", "text").collect():
        src[r.source].append(r.doc_id)
        text[r.doc_id] = hashlib.md5(r.text.encode()).hexdigest()
    size = collections.Counter(text.values())
    key = {d: md5(d) if size[t] * 7 * 50 > n else md5(t) for d, t in text.items()}
    frac = []
    for s, v in src.items():
        u = int(md5("1" + s)[:8], 16)
        frac += [((i * 2**32 + u) / (len(v) * 2.0**32), "1" + s, i, d) for i, d in enumerate(sorted(v, key=lambda d: (key[d], md5(d), d)))]
    place = {d: i * 7 // n for i, (*_, d) in enumerate(sorted(frac))}
    assert dict(zip(out["doc_id"], out["shard"], strict=True)) == place


def test_shards_of_many_small_sources_and_groups(spark):
    """Sources of one row spread over all shards and parts; equal texts come in one shard where counts allow."""
    rows = [(i, f"text {i // 3}", f"host{i // 6}", "x", 1.0, "mine") for i in range(9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, p_ string, f_ double, Slot string")
    one = interleaved(d.where("doc_id % 6 = 0"), 10)
    assert one.columns == ["doc_id", "text", "source", "p_", "f_", "shard", "slot"]
    at = one.toPandas()
    assert at.groupby("shard").size().tolist() == [150] * 10 and sorted(at[at["shard"] == 3]["slot"]) == list(range(150))
    # the fractions behind the places are spread, too: no hundredth of them holds over five times its share
    u = [int(hashlib.md5(f"0:1host{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(1500)]
    assert max(collections.Counter(int(x * 100) for x in u).values()) <= 75
    same = spark.createDataFrame([(i, f"text {i // 3}", f"s{i % 2}") for i in range(9000)], "doc_id long, text string, source string")
    got = shard_digest(same, 10).toPandas()
    split = got.groupby("text_crc32")["shard"].nunique()
    assert (split > 1).mean() < 0.2
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}", "s0") for i in range(3000)], "doc_id long, text string, source string")
    assert shard_digest(hot, 10).groupBy("shard").count().toPandas()["count"].tolist() == [300] * 10


# 5 ---------------------------------------------------------------------------------------------------------------


def grams(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_leaks(text, item):
    """Best window of each document and item over all windows of the item's size, without any filter."""
    out = {}
    for d, w in text.items():
        for i, p in item.items():
            a = grams(p)
            for k in range(max(1, len(w) - len(p) + 1)):
                b = grams(w[k : k + len(p)])
                s = sum((a & b).values()) / max(sum((a | b).values()), 1)
                if s >= 0.8 and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, k)
    return out


def check_leaks(spark, text, item):
    docs_ = spark.createDataFrame(
        [(d, " ".join(w)) for d, w in text.items()],
        "doc_id long, text string",
    ).withColumn("Item_ID", F.lit(7)).withColumn("length", F.lit("x"))
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in item.items()], "item_id long, text string").withColumn("DOC_id", F.lit(3))
    got = leaks(docs_, bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == brute_leaks(text, item)
    return got


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    item = {i: [rng.choice(words) for _ in range(rng.randint(15, 45))] for i in range(20)}
    item[20], item[21], item[22] = ["a", "b"], ["w1", "w2", "w3", "w4"], ["x"] * 12
    text = {}
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if d % 2 == 0:
            p = list(item[rng.randint(0, 19)])
            for _ in range(d % 4):
                p[rng.randrange(len(p))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = p
        text[d] = w
    text[60], text[61], text[62] = ["c", "a", "b", "c"], ["w0", "w1", "w2", "w3", "w4"], ["x"] * 14
    text[63], text[64] = ["w1", "w2", "w3"], []
    assert len(check_leaks(spark, text, item)) >= 10


def test_leaks_find_windows_between_alignments(spark):
    """Swapped halves, insertions, a truncated passage, and one in a very long text."""
    rng = random.Random(5)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    item = {i: new(50) for i in range(4)}
    a, b = item[0][:25], item[0][25:]
    text = {0: new(100) + b + a + new(40), 1: new(30) + a + b + new(9), 2: new(20) + item[1][:24] + ["in"] + item[1][24:] + new(30)}
    text[3] = new(20) + item[1][:2] + ["in"] + item[1][2:47] + ["in"] + item[1][47:] + new(30)
    text[4], text[5] = item[2][:47], new(5) + item[2][4:]
    text[6] = new(15000) + item[3] + new(700) + item[3][:24] + ["z"] + item[3][25:] + new(10)
    got = check_leaks(spark, text, item)
    assert (0, 0) in {(r.doc_id, r.item_id) for r in got} and max(r.bits for r in got) <= 15


def test_leaks_odd_rows(spark, odd):
    one = spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "word word word word word word"), (3, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(odd, one).collect()}
    assert got == {(None, None), (4, None)}
    assert leaks(odd.where("false"), one).count() == 0 and leaks(odd, one.where("false")).count() == 0


def test_leaks_of_the_tables_equal_brute_force(spark, docs):
    split = lambda t: [w for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = {r.doc_id: split(r.text) for r in docs.collect()}
    item = {r.item_id: split(r.text) for r in bench.collect()}
    got = leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == brute_leaks(text, item)


# 6 ---------------------------------------------------------------------------------------------------------------


def test_quality_held_out_and_columns(big, odd, spark):
    out = quality(*big)
    assert held_out(out, big[1], "quality") >= 0.97
    o = quality(odd, big[1])
    assert o.count() == len(ODD) and o.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in o.collect())
    assert {r.score for r in quality(odd, big[1].where("false")).collect()} == {0.5}
    assert quality(spark.createDataFrame([], DOCS), big[1]).count() == 0


def test_quality_statistics_equal_plain_counts(docs):
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "a", "Aa aa! aa 12 $", "x " * 50]
    got = statistics(pa.array(texts))

    def logit(k, n, usual):
        p = (k + 25 * usual) / (n + 25)
        return np.log(p / (1 - p)) if p < 1 - 1e-6 else np.log(p) - np.log(1e-6)

    for t, row in zip(texts, got, strict=True):
        raw = (t or "").encode()
        low = raw.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in re.split(rb"[ \t-\r]+", low) if x]
        n, pairs = len(w), list(zip(w, w[1:], strict=False))
        of = lambda chars: sum(raw.count(bytes([c])) for c in chars)
        size = len(raw) / 4
        mean = (sum(map(len, w)) + 150) / (n + 25)
        square = (sum(len(x) ** 2 for x in w) + 25 * 45) / (n + 25)
        want = [
            logit(of(range(65, 91)), size, 0.06),
            logit(of(range(48, 58)), size, 0.003),
            logit(of(b".,;:!?'\"()-"), size, 0.09),
            logit(of(b"#$%&*+/<=>@[\\]^_`{|}~"), size, 0.004),
        ]
        want += [
            np.log((len(set(w)) + 22.5) / (n + 25)) + 0.12 * np.log(n + 25),
            logit(len(set(pairs)), len(pairs), 0.97),
            logit(sum(a == b for a, b in pairs), len(pairs), 0.01),
        ]
        want += [logit(max(collections.Counter(w).values(), default=0), n, 0.06), np.log(mean), np.log(max(square - mean**2, 0.05)), np.log(n + 25)]
        assert np.allclose(row, want, atol=1e-6), t


def test_discriminant_density():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (500, 3))])
    y = np.repeat([0, 1], 500)
    m = fit(x, y, 0.0, 1e-9, 1.0)
    for c in (0, 1):
        cov = np.cov(x[y == c].T, bias=True)
        d = x[:5] - x[y == c].mean(axis=0)
        want = -0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]) + np.log(501 / 1002)
        got = m.const[c] - 0.5 * (((x[:5] - m.means[c]) @ m.whiten[c].T) ** 2).sum(axis=1)
        assert np.allclose(got, want, atol=1e-4)
    assert statistics(pa.array([None, "", "a b"])).shape == (3, len(FEATURES))


# 8 ---------------------------------------------------------------------------------------------------------------


def word_set(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, percent=80):
    sets = {i: word_set(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, k):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(k)
    base = [f"word{rng.randint(0, 400)}" for _ in range(200)]
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"new{i}"
        texts[10_000 + i] = " ".join(w)
    texts |= {20_000: "", 20_001: " \t", 20_002: "Word", 20_003: "word", 20_004: "word x", 20_005: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k=k).collect()}
    assert got == brute_components(texts, k)


def test_near_duplicates_odd_rows(spark, odd):
    out = near_duplicates(odd, k=5).collect()
    assert len(out) == len(ODD) and all(r.kept for r in out if r.doc_id in (1, 2, None))
    assert near_duplicates(odd.where("false"), k=5).count() == 0


def test_confirmation_in_blocks(spark):
    rng = random.Random(0)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(base[: 100 - rng.randint(0, 8)] + [f"x{i}"]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = spark.createDataFrame([(i, len(word_set(t, 2)), 0) for i, t in texts.items()], "doc_id long, n_shingles long, component long")
    for block in (1 << 19, 900):  # one block, and seven that meet in pairs
        found = {r.node: r.component for r in components(confirmed(df, groups, 2, 80, block)).collect()}
        want = brute_components(texts, 2)
        assert {i: found.get(i, i) for i in texts} == {i: want[i][1] for i in texts}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(e.where("false")).count() == 0


def test_components_write_little(spark, monkeypatch):
    """Stars are written once and gone through no round; a round without hot nodes is written once. Hot or not, components are the same."""
    from tidelane.llm import components as C

    writes = []
    monkeypatch.setattr(C, "cut", lambda df, cut=C.cut: writes.append(1) or cut(df))
    stars = spark.createDataFrame([(9, 1), (1, 5), (8, 2), (9, 1), (2, 2)], "u long, v long")
    assert {r.node: r.component for r in components(stars).collect()} == {1: 1, 5: 1, 9: 1, 2: 2, 8: 2}
    assert len(writes) == 1
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, i) for i in range(401, 430)]
    want = {i: i for e in pairs for i in e}
    for u, v in pairs * len(want):
        want[u] = want[v] = min(want[u], want[v])
    want = {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in pairs)}
    e = spark.createDataFrame(pairs, "u long, v long")
    for hot, most in ((1000, 6), (3, 11)):
        writes.clear()
        got = components(e, hot).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
        assert len(writes) <= most, hot


def test_components_of_small_pieces_run_few_jobs(spark):
    """A few edges, dealt over many files and with hot nodes, take no rounds; rounds, where a piece has fewer edges, find the same."""
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(2000, 2000 + i) for i in range(1, 40)]
    rng.shuffle(pairs)
    e = spark.createDataFrame(pairs, "u long, v long").repartition(40)
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = components(e, 10).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6
    want = {i: i for p in pairs for i in p if p[0] != p[1]}
    edges = [p for p in pairs if p[0] != p[1]]
    while any(want[u] != want[v] for u, v in edges):
        for u, v in edges:
            want[u] = want[v] = min(want[u], want[v])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    for hot in (10, 1000):
        rounds = components(e, hot, piece=5).collect()
        assert {r.node: r.component for r in rounds} == want and len(rounds) == len(want)


def test_forests_of_a_task_in_parts():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    batches = [pa.RecordBatch.from_arrays([pa.array(u[a : a + 7]), pa.array(v[a : a + 7])], names=["u", "v"]) for a in range(0, 400, 7)]
    node, low = forest(u, v)
    want = dict(zip(node.tolist(), low.tolist(), strict=True))
    assert all(want[a] == want[b] <= min(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True))
    for held in (1, 50, 10_000):
        out = [np.array([b.column(i).to_numpy() for i in (0, 1)]) for b in _forests(False, held)(iter(batches))]
        node, low = forest(*np.concatenate(out, axis=1))
        assert (node > low).sum() == len({k for k, c in want.items() if k != c}) and all(want[k] == c for k, c in zip(node.tolist(), low.tolist(), strict=True))


def test_frequent_keys_are_joined_alike(spark):
    left = spark.createDataFrame([(i % 7, i) for i in range(50)] + [(None, 50), (99, 51)], "k long, i long")
    right = spark.createDataFrame([(k, 100 + k, 8) for k in range(5)], "k long, x long, n long")
    want = sorted((i, None if k is None or k > 4 else 100 + k) for k, i in left.collect())
    for most in (None, 8, 5000):
        out = join_frequent(left, right, ["k"], "n", 52, most)
        assert out.columns == ["k", "i", "x"] and sorted((r.i, r.x) for r in out.collect()) == want


# 9, 10 -----------------------------------------------------------------------------------------------------------


def test_token_counts_of_hard_texts(spark):
    """No rows, a run of 50,000 letters, one without white space in other scripts, and a missing vocabulary."""
    rows = [(1, "a" * 50_000), (2, "\u4e2d\u6587" * 3000), (3, " " * 20_000), (4, "x y " * 10_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("File", F.lit("f")).withColumn("payload", F.lit(1))
    enc = encoder(queries.VOCABULARY, queries.PATTERN)
    got = {r.doc_id: r.n_tokens for r in document_counts(d, queries.VOCABULARY, queries.PATTERN, queries.SEPARATOR, 1000).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in rows}
    assert document_counts(d.where("false"), queries.VOCABULARY, queries.PATTERN, queries.SEPARATOR).count() == 0
    with pytest.raises(FileNotFoundError, match="no vocabulary"):
        encoder("/nowhere", queries.PATTERN)


def test_token_counts_round_trip(spark, docs, odd):
    enc = encoder(queries.VOCABULARY, queries.PATTERN)
    for df, block in ((docs.limit(60), 1 << 20), (odd, 64)):
        got = sorted((r.doc_id or -1, r.n_tokens) for r in document_counts(df, queries.VOCABULARY, queries.PATTERN, queries.SEPARATOR, block).collect())
        want = sorted((r.doc_id or -1, len(enc.encode_ordinary(r.text or ""))) for r in df.select("doc_id", "text").collect())
        assert got == want


def test_scan_over_blocks_and_spans(spark):
    rng = np.random.default_rng(0)
    for end in (True, False):
        ids = rng.integers(0, 4, 997).astype("<u2")
        ids[-1] = 0 if end else 1
        raw = ids.tobytes()
        blocks = [("f", i // 14, raw[i : i + 14]) for i in range(0, len(raw), 14)] + [("g", 0, np.array([1, 1], "<u2").tobytes())]
        got = separator_scan(spark.createDataFrame(blocks, "file string, block long, payload binary"), 0, span=5)
        have = [r.n_tokens for r in sorted(got.where("file = 'f'").collect(), key=lambda r: r.ordinal)]
        cut = np.flatnonzero(ids == 0)
        want = np.diff(np.concatenate([[-1], cut])) - 1
        assert have == [*want.tolist(), *([] if end else [len(ids) - 1 - int(cut[-1])])]
        assert [r.n_tokens for r in got.where("file = 'g'").collect()] == [2]


def test_html(spark):
    page = '<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home, now.</a></nav><div id="content"><h2>Head</h2><p>One para, with text &amp; more.<br>Line</p><p>Second.</p><div class="comments"><p>Nice post, I agree, friend, with everything, all of it.</p></div></div><aside><p>Popular, things.</p></aside><form><p>Your mail, please.</p></form><footer>foot, note.</footer></body></html>'
    assert main_text(page) == "Head\n\nOne para, with text & more. Line\n\nSecond."
    assert main_text("<article><h1>T</h1><p>x<p>y<script>var a='</p>';</script><p>a &lt; b &eacute;") == "T\n\nx\n\ny\n\na < b é"
    assert main_text("<body><article><h1>T</h1><p>x.</p></article><div><p>" + "Much, longer text. " * 20 + "</p></div></body>") == "T\n\nx."
    assert main_text('<article><p>a > b</p><img alt="<p>no</p>"><p title="x > y">z</p></article>') == "a > b\n\nz"
    rows = spark.createDataFrame(
        [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>only <b>this"), (4, "u", "a < b")],
        "page_id long, url string, html string",
    )
    got = {r.page_id: (r.text, r.n_chars) for r in extract(rows).collect()}
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[None] == ("only this", 9) and got[4] == ("a < b", 5)


def test_html_articles_follow_the_scores():
    long = "Much, longer text. " * 20
    text = long.strip()
    teaser = "<article><h2>Card</h2><p>Read this.</p></article>"
    assert text in main_text(f"<main><h1>T</h1><div><p>{long}</p><p>{long}</p></div>{teaser}</main>")
    assert main_text(f"<body>{teaser}<div><h1>T</h1><p>{long}</p><p>{long}</p></div></body>").endswith(f"T\n\n{text}\n\n{text}")
    assert text in main_text(f"<body><div><p>{long}</p></div>{teaser}</body>")
    assert main_text(
        f"<body><article><p>{long}A.</p></article><p>Between.</p><article><p>{long}</p><p>{long}B.</p></article></body>"
    ) == f"{text} A.\n\n{text}\n\n{text} B."


def test_html_names_are_whole_and_wrappers_pass():
    long = "Much, longer text. " * 20
    text = long.strip()
    for name in ("class='layout has-sidebar'", "class=no-sidebar", 'class="page search-results"', "id='social-history'", "id=ad-hoc", "class=sidebar", "class='page search'"):
        assert main_text(f"<body><div {name}><div><p>{long}</p></div><p>{long}</p></div></body>") == f"{text}\n\n{text}", name
    assert main_text(f"<body><article class='comments-open'><p>{long}</p></article></body>") == text
    assert main_text(
        f"<body><form id=aspnetForm><div class=Sidebar>Popular, things.</div><div><p>{long}</p></div></form><form>Your mail.</form></body>"
    ) == text
    assert main_text(f"<body><div><p>{long}</p><div class='box ad'>Buy, now.</div><article class='comment'>Nice, post.</article></div></body>") == text


def test_html_parses_all_tags_alike():
    import time

    # from each br on, the quotes run to the apostrophe at the end, which none closes
    page = "<article><p>" + "<br '>word '" * 200 + "it's</p><p title=\"<b>no</b>\">yes.</p></article>"
    assert main_text(page).endswith("it's\n\nyes.")
    began = time.perf_counter()
    main_text("<article>" + '<a "> " x ' * 100000)
    assert time.perf_counter() - began < 20


def test_html_path_scores_decide(monkeypatch):
    """Without article and main, what the page's text is follows from the path ratios alone."""
    from tidelane.llm import html

    long = "Much, longer text, of a paragraph. " * 12
    page = f"<body><div class=a><div>Short one</div><div>Or two</div></div><div class=b><h2>Head</h2><p>{long}</p><p>Brief.</p><section class='search-methods'><p>{long}</p></section></div><div class=c><span>More here</span></div></body>"
    want = f"Head\n\n{long.strip()}\n\nBrief.\n\n{long.strip()}"
    assert main_text(page) == want
    monkeypatch.setattr(html, "path_scores", lambda page: dict.fromkeys(page.path, 1.0))
    assert main_text(page) != want


def test_html_is_linear_in_the_page():
    import time

    for part in ("<div>x", "<blockquote><p>x", "<x-a>", "</b-x><div>", "<p><td><x>", "<table><tr><td>", "<script>", "<!-- ", "<a href='", "<li><ul>y"):
        began = time.perf_counter()
        main_text(part * 100_000)
        assert time.perf_counter() - began < 20, part


def test_html_odd_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, "v", "<p>" + "word " * 400_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit("mine")).withColumn("n_chars", F.lit("x"))
    out = sorted((r.page_id, r.n_chars) for r in extract(d).collect())
    assert out == [(1, 1), (1, 1), (2, 5 * 400_000 - 1)]
    assert extract(d.where("false")).count() == 0


def test_html_equals_articles(spark):
    from html import unescape

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html[r.html.find("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"<(?!p>|/p>|h1>|/h1>)[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert main_text(r.html) == "\n\n".join(x for x in parts if x)


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    out = P.run(spark, SF).toPandas()
    assert not out.empty and not out["doc_id"].duplicated().any() and set(out["shard"]) <= set(range(24))
    ds = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.drop_near_duplicates(spark, ds, SF)
    assert kept.columns == ds.columns
    texts = {r.doc_id: r.text for r in ds.collect()}
    comp = brute_components(texts, 5)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in comp.items() if i == c}


def test_pipeline_stages_equal_brute_force(spark, odd):
    """What each stage decides on rows with null ids and texts, repeated rows and benchmark passages."""
    import corpus_pipeline as P

    split = lambda t: [w for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w]
    bench = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(30)]
    rows = [(i, t, "en", f"src{i % 4}", 1) for i, t in enumerate(text)] + [(100, text[0] + " x", "en", "src1", 1), (7, text[7], "en", "src3", 1)]
    rows += [
        (200, text[1] + " " + " ".join(bench[0]), "en", "src0", 1),
        (None, " ".join(bench[1]), "de", "src0", 1),
        (None, "clean words only", "de", None, 1),
        (201, None, None, None, None),
    ]
    ds = spark.createDataFrame(rows, DOCS)
    kept = P.drop_near_duplicates(spark, ds, SF)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted([*range(1, 30), -1, -1, -1, 200, 201])
    clean = P.drop_leaks(spark, kept, SF).collect()
    assert sorted((r.doc_id or -1) for r in clean) == sorted([*range(1, 30), -1, -1, 201])
    mixed = P.mix(spark, ds, SF).toPandas()
    tokens = lambda p: p["text"].fillna("").str.split().str.len().groupby(p["source"].fillna("src0")).sum()
    cap, got = tokens(ds.toPandas()), tokens(mixed)
    total = min(cap[f"src{i}"] * 10 // w for i, w in enumerate((4, 3, 2, 1)))
    assert all(abs(got[f"src{i}"] - total * w / 10) <= 130 for i, w in enumerate((4, 3, 2, 1)))
    assert set(P.shard(spark, ds, SF).toPandas()["slot"]) <= {0, 1}
    for _, stage in P.STAGES:
        assert stage(spark, ds.where("false"), SF).count() == 0
    assert len(P.drop_leaks(spark, odd, SF).columns) == len(odd.columns)


def test_pipeline_keeps_every_text_of_an_id(spark):
    import corpus_pipeline as P

    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (6, b + " x", "en", "s", 1), (7, c, "en", "s", 1), (7, c + " y", "en", "s", 1)]
    ds = spark.createDataFrame(rows, DOCS).withColumn("Node_x", F.lit(1))
    kept = P.drop_near_duplicates(spark, ds, SF)
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == ds.columns and len(got) == 3 and got[0] == (3, a)
    assert got[1] == (6, b + " x") and got[2] in ((7, c), (7, c + " y"))


def test_near_duplicate_stage_runs_few_jobs(spark):
    """The driver keeps memory for every job and exchange."""
    import corpus_pipeline as P

    ds = spark.read.parquet(f"{SF}/documents.parquet")
    spark.sparkContext.setJobGroup("near-duplicate stage", "")
    try:
        assert P.drop_near_duplicates(spark, ds, SF).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-duplicate stage")) <= 140


def test_labelled_sample_is_bounded(spark):
    # many rows of few ids: one row an id, and no more than the bound
    ds = spark.createDataFrame([(i % 2 + 1, f"text {i}") for i in range(5000)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(ds, labels, "quality", 2).collect()
    assert len(rows) <= 2 and len({r.doc_id for r in rows}) == len(rows)
    every = {r.doc_id: r.y for r in labelled_sample(ds, labels, "quality", 100).collect()}
    assert set(every) <= {1, 2} and every.get(1, 1) == 1
    assert labelled_sample(ds.limit(0), labels, "quality", 5).count() == 0


def test_queries_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert pd.notna(bootstrap)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    r = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(tuple(x[names.index(k)] for k in cols) for x in r.fetchall())
