"""The corpus operators against SQL, brute force, and inputs with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF, plain, same
from faultline.llm import common, decontaminate, language, licenses, linededup, mixing, neardup, pii, quality, repeats, urls
from faultline.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, component string, key string, hash string, print long, label string"


def odd(spark, rows):
    """Documents (id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, 9, 9, "x", "x", "x", 9, "x") for i, t, s in rows], SCHEMA)


LONG = " ".join(f"w{k % 977}" for k in range(30_000))
EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", None), (5, "x y z", "b"), (5, "x y z", "b"), (None, "x y z", "b"), (7, LONG, "b"), (8, LONG, "a"), (9, "é ü ß\n\né ü ß", "c")]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(ORACLE[name]))


@pytest.mark.parametrize("make", [lambda d, s: mixing.mix(d), lambda d, s: neardup.near_duplicates(d, 4), lambda d, s: linededup.dedup_lines(d), lambda d, s: quality.judge(d, s.createDataFrame([(4, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")), lambda d, s: pii.find(d), lambda d, s: language.identify(d, language.train(d)), lambda d, s: licenses.scan(d), lambda d, s: repeats.repeated_passages(d), lambda d, s: decontaminate.leaks(d, s.createDataFrame([(1, None), (2, ""), (3, "x y z")], "item_id long, text string"))])
def test_odd_rows_and_empty_tables(spark, make):
    many = make(odd(spark, EDGES), spark)
    n = many.count()
    if {"taken"} & set(many.columns) or {"kept"} & set(many.columns) or {"n_deleted"} & set(many.columns) or {"lang_pred"} & set(many.columns) or {"base_sha256"} & set(many.columns):
        assert n == len(EDGES)
    assert make(odd(spark, []), spark).count() == 0


def test_word_hashes_like_words():
    texts = ["Hello  World", None, "", "a\x0bb c\x85d", "é É", "x" * 70_000 + " y", "HELLO world"]
    w = common.Words(pa.array(texts))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(w.first).tolist() == [len(e) for e in expected]
    assert w.hash[0] == w.hash[w.first[6]] and w.hash[w.first[4]] != w.hash[w.first[4] + 1]


def test_components_like_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)]
    label = list(range(200))
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == label[v] for e in edges for v in e)


def near(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_near_duplicates_like_all_pairs(spark):
    rng = random.Random(2)
    docs = []
    for g in range(12):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([4, 9, 60, 300]))]
        docs += [" ".join(near(rng, base, rng.randrange(0, 1 + len(base) // 25))) for _ in range(rng.choice([1, 3, 40]))]
    docs += docs[:20] + ["a b", "A b", "", None]
    sets = [({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()) for w in ((d or "").lower().split() for d in docs)]
    label = list(range(len(docs)))
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(len(docs)):
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    got = neardup.near_duplicates(odd(spark, [(i, d, "s") for i, d in enumerate(docs)]), 4).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(len(s), x, x == i) for i, (s, x) in enumerate(zip(sets, label, strict=True))]


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    """Families that share a long boilerplate: all are in the same lists, few are links, and lists are split again and again."""
    monkeypatch.setattr(neardup, "LIST", 4)
    monkeypatch.setattr(neardup, "PAIRED", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(12)
    shell = [f"b{k}" for k in range(70)]
    docs = []
    for _ in range(40):
        body = [f"u{rng.randrange(10**6)}" for _ in range(18)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(body)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append(" ".join(shell + own))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (d.split() for d in docs)]
    label = list(range(len(docs)))
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(len(docs)):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert 1 < len(set(label)) < len(docs)
    got = neardup.near_duplicates(odd(spark, [(i, d, "s") for i, d in enumerate(docs)]), 4).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label


@pytest.mark.parametrize(("whole", "block", "common", "deep"), [(0, 1024, 64, 512), (10**6, 16, 2, 512), (10**6, 16, 10**6, 20)])
def test_near_duplicates_in_one_large_group(spark, monkeypatch, whole, block, common, deep):
    """Copies with more or fewer words changed, some linked with few others only: by dealing, and all with all in small blocks."""
    for name, value in (("LIST", 4), ("PAIRED", 4), ("PIVOTS", 1), ("WHOLE", whole), ("BLOCK", block), ("COMMON", common), ("DEEP", deep)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(23)
    base = [f"b{k}" for k in range(40)]
    docs = [" ".join(near(rng, base, rng.randrange(5))) for _ in range(110)]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (d.split() for d in docs)]
    label = list(range(len(docs)))
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(len(docs)):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert 1 < len(set(label)) < len(docs)
    got = neardup.near_duplicates(odd(spark, [(i, d, "s") for i, d in enumerate(docs)]), 4).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label


def test_pivots_are_of_other_components(spark):
    """A list of one component and one document apart: a pair for that one at most, however many pivots and lists there are."""
    rows = [(v, c, 0 if c < 60 else c) for v in range(20) for c in range(61)]
    got = neardup._star(spark.createDataFrame(rows, "value long, cid long, label long")).collect()
    assert all(r.a == 60 for r in got) and len(got) <= 60


def test_dealing_misses_next_to_no_link():
    for joint in neardup.JOINT:
        assert (1 - 0.8**joint) ** neardup._often(0.8, joint) <= neardup.LOST


def test_estimates_rule_out_next_to_no_link():
    lost = sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(65) if k / 64 < neardup._floor(0.8, np.array([64]))[0])
    assert lost < 1e-7


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = urls.bloom(keys)
    probe = spark.range(9000).select("id", urls.may_have(bits.scalar(), F.concat(F.lit("k"), "id")).alias("hit"))
    assert probe.where("id < 3000 and not hit").count() == 0 and probe.where("id >= 3000 and hit").count() < 200


def test_url_rules(spark):
    rows = ["https://a.EXAMPLE.org/en/12?q", "http://x.org", None, "nothing", "http://example.org/es/a#b", "http://s.com/de/", "http://notorg/", "http://l.com/p/", "https://www.l.com/p"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame([("http://l.com/p#z",)], "url string")).orderBy("page_id").collect()]
    assert got == [("a.example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/es/a", "example.org/es/", "block"), ("s.com", "/de/", "com/de/", "block"), ("notorg", "/", None, "allow"), ("l.com", "/p/", None, "block"), ("www.l.com", "/p", None, "block")]


def test_leaks_and_paraphrases(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common_words = [word() for _ in range(30)]
    text = lambda n: [rng.choice(common_words) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [text(n) for n in (14, 25, 40, 58, 90)]
    docs, wanted = [], set()
    for d in range(120):
        body = text(rng.randrange(5, 400))
        if d % 4 == 0:
            i = d // 4 % len(items)
            passage = [w if rng.random() > 0.12 else word() for w in items[i]] if d % 8 else items[i]
            at = rng.randrange(len(body))
            body[at:at] = passage
            wanted.add((d, i))
        docs.append((d, " ".join(body), "s"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd(spark, docs), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()}
    assert found <= wanted and len(found) >= len(wanted) - 1 and {w for w in wanted if w[0] % 8 == 0} <= found


def test_leaks_of_long_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common_words = [word() for _ in range(300)]
    text = lambda n: [rng.choice(common_words) if rng.random() < 0.6 else word() for _ in range(n)]
    items = [text(n) for n in (60, 390, 1000, 3000, 12_000)]
    docs, wanted = [], set()
    for d in range(40):
        body = text(rng.randrange(5, 6000))
        if d % 2 == 0:
            i = d // 2 % len(items)
            passage = items[i] if d < 20 else [x for w in items[i] for x in rng.choices(([w], [word()], [], [w, word()]), (84, 8, 4, 4))[0]]
            at = rng.randrange(len(body))
            body[at:at] = passage
            wanted.add((d, i))
        elif d % 4 == 1:
            body += items[3][: 1500 if d % 8 == 1 else 384]  # half of a passage is none
        docs.append((d, " ".join(body), "s"))
    found = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(odd(spark, docs), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()}
    assert set(found) == wanted and all(found[d, i] == 1 for d, i in wanted if d < 20)


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate._lcs(a, b) == table[-1][-1]


def test_licenses_like_containment(spark):
    rng = random.Random(9)
    docs, wanted = [], set()
    for d in range(60):
        body = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            name = sorted(licenses.TEMPLATES)[d // 3 % len(licenses.TEMPLATES)]
            at = rng.randrange(len(body) + 1)
            body[at:at] = licenses.TEMPLATES[name].upper().split() if d % 2 else licenses.TEMPLATES[name].split()
            wanted.add((d, name))
        docs.append((d, " ".join(body), "s"))
    found = {(r.doc_id, r.license) for r in licenses.scan(odd(spark, docs)).collect()}
    assert wanted <= found and {d for d, _ in found} == {d for d, _ in wanted}


def test_short_notices_and_tags(spark):
    notices = [("MIT", "Licensed under the MIT License."), ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "covered by the GNU Lesser General Public License v3"), ("ISC", "Licensed under the ISC license"), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("CC-BY-4.0", "Licensed under CC BY 4.0")]
    found = {}
    for r in licenses.scan(odd(spark, [(i, f"one two three\n{t}\nfour five", "s") for i, (_, t) in enumerate(notices)] + [(99, "the general public has a license to see version 2 of it", "s")])).collect():
        found.setdefault(r.doc_id, set()).add(re.sub("-(short|spdx).*", "", r.license))
    assert found == {i: {name} for i, (name, _) in enumerate(notices)}


def test_quality_counts_like_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a b c d e a b c d e f"), (-2, "x " * 40), (-3, "l\nl\n \nl|<")], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum((r.text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), r.doc_id
        assert g.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (g.kept and g.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [g for i, g in got.items() if labels.get(i) == 1 and not g.base_failed]
    assert np.mean([g.kept for g in good]) > 0.98


@pytest.mark.parametrize(("scale", "part", "most"), [("sf0.001", 1, 0.1), ("sf0.01", 1, 0.1), ("sf0.01", 8, 0.35), ("sf0.1", 1, 0.1), ("sf0.1", 64, 0.35)])
def test_quality_rejects_labelled_junk_at_every_size(spark, scale, part, most):
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    few = labels.where(F.pmod(F.xxhash64(F.lit("x"), "doc_id"), F.lit(part)) == 0)
    rows = quality.judge(docs, few).where("not base_failed").join(labels, "doc_id").where("coalesce(toxic, 0) = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[0] < most and kept[1] > 0.95, kept


def test_quality_without_two_trusted_documents(spark):
    docs = odd(spark, [(i, " ".join(f"w{i}x{k}" for k in range(30)), "s") for i in range(4)])
    for rows in ([], [(0, 1, 0)]):
        got = quality.judge(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert got.where("kept").count() == 4 and "__least" not in got.columns


def test_maximal_runs_like_all_pairs(spark):
    rng = random.Random(11)
    block = [f"line {k} of it" for k in range(45)]
    texts = []
    for d in range(60):
        own = [f"own {d} {k}" if rng.random() < 0.6 else "common" for k in range(rng.randrange(6))]
        a, b = sorted((rng.randrange(46), rng.randrange(46)))
        texts.append("\n".join([*own, *block[a:b], *(["", " "] if d % 5 == 0 else []), *(block[3:9] * 2 if d % 7 == 0 else [])]))
    texts += [texts[0]] * 3 + ["common", "common\ncommon\ncommon", "", None]
    lines = [[(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip()] for t in texts]
    # the longest common prefix with any other suffix, by all pairs
    every = [(d, k) for d, own in enumerate(lines) for k in range(len(own))]
    names = [[x for _, x in own] for own in lines]
    most = {}
    for d, k in every:
        for e, j in every:
            if (d, k) != (e, j) and names[d][k] == names[e][j]:
                n = 0
                while k + n < len(names[d]) and j + n < len(names[e]) and names[d][k + n] == names[e][j + n]:
                    n += 1
                most[d, k] = max(most.get((d, k), 0), n)
    expected = sorted((d, lines[d][k][0], n) for (d, k), n in most.items() if n > 1 and most.get((d, k - 1), 0) <= n)
    documents = odd(spark, [(d, t, "s") for d, t in enumerate(texts)])
    assert sorted(map(tuple, linededup.repeated_runs(documents).collect())) == expected
    assert linededup.repeated_runs(odd(spark, EDGES)).count() == 0
    assert linededup.repeated_runs(odd(spark, EDGES), least=1).count() == 6


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in pii.BASE.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_pii_like_python(spark):
    extra = ["mail a.b@c.d.e and é a.b@c.d.e.", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5", "4111 1111 1111 1111, 4111111111111112 and 4111-1111-1111-1111", "+1 (988) 555-2485 +12", "x4111111111111111x 94111111111111111", "a@b.c_d@e.f a@b.c.@g.h é_i@j.k", "1.2.3.4.5.6.7.8 4 111 1111-1111 1111 11 1", "1 " * 40_000, "7" * 60_000, "a@" + "b." * 20_000 + "c", "1.2.3.4 é " * 3000, "", None]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        spans = base_spans(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (r.doc_id, g.spans, text)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE)
        assert g.spans.startswith(text) and g.n_spans == len([x for x in g.spans.split(",") if x])
        added = [(int(a), int(b)) for x in g.spans[len(text) :].split(",") if x for _, a, b in [x.split(":")]]
        assert not any(a < e and s < b for a, b in added for _, s, e in spans) and g.n_added == len(added)


def planted_secrets(rng):
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    digits = "0123456789"
    return [
        ('token = "', some(digits + "abcdef", 40), '"'),
        ('TOKEN = "', some(digits + "ABCDEF", 40), '"'),
        ("api_key: ", "ghp_" + some(digits + lower + upper, 36), ""),
        ("aws_secret=", "AKIA" + some(digits + upper, 16), ""),
        ('password="', some(digits + lower + upper + "+/", 24), '"'),
        ("Authorization: Bearer ", some(digits + lower, 32), ""),
    ]


def test_pii_finds_planted_secrets(spark):
    rng = random.Random(3)
    docs, wanted = [], {}
    plain_words = "the release-2024-final-notes of src/lib2/module3/file7 came on 2024-05-06 as build20240506 with part number 1234567890123456".split()
    for d in range(600):
        body = [rng.choice(plain_words) if rng.random() < 0.05 else "word" for _ in range(60)]
        if d % 3 == 0:
            cue, secret, end = planted_secrets(rng)[d // 3 % 6]
            if any(c.isdigit() for c in secret):
                body.insert(30, cue + secret + end)
                wanted[d] = secret
        docs.append((d, " ".join(body), "s"))
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.find(odd(spark, docs)).collect()}
    caught = sum(any(docs[d][1][int(a) : int(b)] == x for _, a, b in got[d]) for d, x in wanted.items())
    false = sum(bool(got[d]) for d in got if d not in wanted)
    assert caught >= 0.9 * len(wanted) and false <= 0.05 * (len(docs) - len(wanted)), (caught, len(wanted), false)


def test_pii_of_very_many_matches(spark):
    texts = ["1.2.3.4 é " * 20_000, "k9 " + "abcdefghijk0l " * 20_000 + "+1 (988) 555-2485 " * 2000]
    pii.find(odd(spark, [(1, texts[0][:1000], "s")])).collect()
    began = time.time()
    got = {r.doc_id: r for r in pii.find(odd(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert got[0].n_ip == 20_000 and got[1].n_phone == 2000 and time.time() - began < 30


def test_em_trusts_labelers_that_agree():
    post = pii.reliabilities({2 + 3 * 2 + 9 * 2 + 27 * 2 + 81 * 2: 40, 0: 60, 1 + 3 + 9 + 27 + 81: 3})
    assert post[242] > 0.9 and post[0] < 0.1


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    none = language.identify(odd(spark, [(1, "123 !", "s"), (2, None, "s")]), language.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2


def test_repeats_like_all_windows(spark):
    rng = random.Random(6)
    word = lambda: f"t{rng.randrange(60)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 20, 30)]
    docs = []
    for d in range(80):
        body = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            at = rng.randrange(len(body) + 1)
            body[at:at] = p if rng.random() < 0.6 else p[a:]
        docs.append((d, " ".join(body), "s"))
    n = Counter(tuple(w[k : k + 50]) for _, t, _ in docs for w in [t.split()] for k in range(len(w) - 49))
    expected = []
    for d, t, _ in docs:
        w = t.split()
        for k in range(len(w) - 49):
            if n[tuple(w[k : k + 50])] > 1:
                if expected and expected[-1][0] == d and k <= expected[-1][1] + expected[-1][2]:
                    expected[-1][2] = k + 50 - expected[-1][1]
                else:
                    expected.append([d, k, 50])
    got = sorted([r.doc_id, r.start, r.n_words] for r in repeats.repeated_passages(odd(spark, docs)).collect())
    assert got == sorted(expected)


def test_mix_near_targets_and_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, second = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == second
    sums = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("m")).collect()
    assert all(abs(r.n - r.t) <= 0.1 * r.t and r.m <= 2 for r in sums)


def test_pipeline_like_its_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").select("doc_id", "text", "source").collect()
    lines, first, kept = [], {}, []
    for r in sorted(judged, key=lambda r: r.doc_id):
        own = r.text.split("\n")
        at = [k for k, x in enumerate(own) if x.strip(" \t\n\x0b\x0c\r")]
        lines.append((r, own, at))
        for k, (a, b) in enumerate(zip(at, at[1:])):
            first.setdefault((own[a], own[b]), (r.doc_id, k))
    for r, own, at in lines:
        gone = {x for k, (a, b) in enumerate(zip(at, at[1:])) if first[own[a], own[b]] < (r.doc_id, k) for x in (a, b)}
        text = "\n".join(x for k, x in enumerate(own) if k not in gone)
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            kept.append((r.doc_id, text, r.source))
    sets = {d: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()) for d, t, _ in kept for w in [t.lower().split()]}
    ids = sorted(sets)
    label = {d: d for d in ids}
    for _ in range(5):
        for i in ids:
            for j in ids:
                if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    passages = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t, _ in kept if label[d] == d and not any(p in " ".join(t.lower().split()) for p in passages)]
    got = sorted((r.doc_id, r.size) for r in c.run(spark, SF).collect())
    assert got == sorted((d, len(t.split())) for d, t in kept)
    assert plain(None) == "null"
