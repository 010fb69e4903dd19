"""Kneser-Ney against a plain model, near-duplicates against all pairs, and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidewire.llm import kneser_ney as kn
from tidewire.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    """Interpolated modified Kneser-Ney of order 4 over letter classes, by dictionaries."""

    def __init__(self, texts):
        often = Counter(c for t in texts for c in t)
        kept = sorted(often, key=lambda c: (-often[c], ord(c)))[:kn.LETTERS]
        self.classes = {c: i + 2 for i, c in enumerate(kept)}
        self.n = {4: Counter(g for t in texts for g in self.grams(t))}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.cut, self.total, self.spare = {}, {}, {}
        for k in range(1, 5):
            c = Counter(self.n[k].values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0
            self.cut[k] = [max(0.0, min(i, i - (i + 1) * y * c[i + 1] / c[i])) if c[i] and c[i + 1] else i / 2 for i in (1, 2, 3)]
            total, spare = Counter(), Counter()
            for g, n in self.n[k].items():
                total[g[:-1]] += n
                spare[g[:-1]] += self.cut[k][min(n, 3) - 1]
            self.total[k], self.spare[k] = total, spare

    def grams(self, text):
        c = [0, 0, 0, *(self.classes.get(x, 1) for x in text)]
        return [tuple(c[i:i + 4]) for i in range(len(text))]

    def p(self, g):
        if not g:
            return 1 / kn.SPAN
        k, low = len(g), self.p(g[1:])
        if g[:-1] not in self.total[k]:
            return low
        n = self.n[k].get(g, 0)
        rest = max(0.0, n - self.cut[k][min(n, 3) - 1]) if n else 0.0
        return rest / self.total[k][g[:-1]] + self.spare[k][g[:-1]] / self.total[k][g[:-1]] * low

    def entropy(self, text):
        return -sum(math.log(self.p(g)) for g in self.grams(text)) / len(text)


def test_entropies_equal_a_plain_model(spark, small):
    docs, labels = small["documents"], small["labels"]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    rows = docs.collect()
    by_lang = defaultdict(list)
    for r in rows:
        if r.doc_id in good:
            by_lang[r.lang].append(r.text)
    model = kn.QualityModel(docs, labels)
    pooled = Plain([t for texts in by_lang.values() for t in texts])
    plain = {lang: Plain(texts) for lang, texts in by_lang.items() if len(texts) >= 30}
    got = {r.doc_id: r for r in model.scored().collect()}
    assert len(got) == len(rows)
    for r in rows[::7]:
        want = plain.get(r.lang, pooled).entropy(r.text)
        assert got[r.doc_id].n_chars == len(r.text) and abs(-got[r.doc_id].logp / len(r.text) - want) < 1e-4
    verdict = {r.doc_id: r.kept for r in model.judged().collect()}
    assert all(verdict[d] for d in good)
    bad = [r.doc_id for r in labels.collect() if r.quality == 0]
    assert sum(not verdict[d] for d in bad) >= 0.7 * len(bad)


def test_models_in_several_sets_score_the_same(spark, small):
    one = kn.QualityModel(small["documents"], small["labels"], least_docs=5)
    many = kn.QualityModel(small["documents"], small["labels"], least_docs=5, set_rows=1, broadcast_ids=0)
    assert len(many._sets()) > 1
    a, b = ({r.doc_id: r.logp for r in m.scored().collect()} for m in (one, many))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * abs(a[k]) + 1e-9 for k in a)


def test_no_letter_is_folded(spark):
    """More letters than any alphabet of 62 or 65,535, outside the basic plane too; parts of models add up."""
    points = [0x61 + i for i in range(26)] + [0x4E00 + 7 * i for i in range(300)] + [0x1F300 + i for i in range(300)]
    pick = np.random.default_rng(3)
    texts = ["".join(chr(points[k]) for k in pick.integers(0, len(points), 80)) for _ in range(60)]
    rows = [(i, t, "xx") for i, t in enumerate(texts)] + [(100 + i, "".join(reversed(t)), "xx") for i, t in enumerate(texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    plain = Plain(texts)
    one, many = (kn.QualityModel(docs, labels, part_rows=n) for n in (1 << 22, 2000))
    a, b = ({r.doc_id: (r.n_chars, r.logp) for r in m.scored().collect()} for m in (one, many))
    assert max(many.parts.values()) > 2 and max(one.parts.values()) == 1
    for i, t, _ in rows:
        assert a[i][0] == b[i][0] == 80 and abs(a[i][1] - b[i][1]) < 1e-3 and abs(-a[i][1] / 80 - plain.entropy(t)) < 1e-4
    held = [sorted((r.n_chars, round(r.logp, 2), round(r.firsts[3], 2)) for r in m.trusted_scored().collect()) for m in (one, many)]
    assert held[0] == held[1] and len(held[0]) == 60


def test_windows_of_very_many_letters_are_told_apart():
    text = "".join(chr(k) for k in range(0x20000, 0x2A000)) + "abcdabcd\0\x01"
    context, letter, n = kn.counted([text, text])
    got = {(int(c), int(x)): int(k) for c, x, k in zip(context, letter, n)}
    want = Counter()
    code = [0, 0, 0, *(ord(c) + 1 for c in text)]
    for a, b, c, d in zip(code, code[1:], code[2:], code[3:]):
        want[(a << 42 | b << 21 | c, d)] += 2
    assert got == want


def test_junk_and_little_clean_text_is_rejected(spark):
    """Planted toxic, repeated and short junk of a made language, and clean text that no label names."""
    rng = np.random.default_rng(7)
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    weights = np.arange(10, 0, -1) / 55

    def clean(n):
        return " ".join("".join(rng.choice(parts, rng.integers(1, 4), p=weights)) for _ in range(n // 5))[:n]

    sizes = rng.choice([60, 200, 700, 2000], 1000)
    rows = [(i, clean(n)) for i, n in enumerate(sizes)]
    labels = [(i, 1, 0) for i in range(600)]  # 600 and on are clean, and not trusted
    junk = {"short": ["wnrt ohed dnah gzrt"[:k] + " xq" for k in range(12, 19)],
            "repeated": ["anehre hethwn " * 30 for _ in range(5)],
            "toxic": [" ".join(w if k % 15 else "kzuv" for k, w in enumerate(clean(700).split())) for _ in range(10)]}
    ids = {}
    for kind, texts in junk.items():
        ids[kind] = range(len(rows), len(rows) + len(texts))
        rows += zip(ids[kind], texts)
    docs = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in kn.QualityModel(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).judged().collect()}
    for kind, found in ids.items():
        assert not any(kept[i] for i in found), kind
    lost = sum(not kept[i] for i in range(600, 1000)) / 400
    assert 0 < lost < 0.03 and sum(not kept[i] for i in range(600)) / 600 < 0.03


def test_odd_rows_are_scored(spark, odd_docs, small):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 1, None), (6, 0, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = kn.QualityModel(odd_docs, labels).judged().collect()
    assert len(got) == odd_docs.count() and all(r.kept for r in got if r.doc_id in (1, 2))
    none = kn.QualityModel(odd_docs, labels.limit(0)).judged().collect()
    assert len(none) == odd_docs.count() and all(r.kept for r in none)
    assert kn.QualityModel(odd_docs.limit(0), labels).judged().count() == 0
    assert kn.kept_documents(odd_docs, labels).columns == odd_docs.columns


def sets_of(rows, size):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        n = min(size, len(w))
        out[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    return out


def components(rows, size):
    sets, top = sets_of(rows, size), {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.fixture(scope="module")
def groups(spark):
    """A chain whose ends are unlike, a group of near copies with few links, copies, odd texts."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 80)]
    rows = []
    for _ in range(150):  # near copies around one text: about half of all pairs are links
        text = list(base)
        for k in rng.integers(0, 80, rng.integers(1, 9)):
            text[k] = words[rng.integers(0, 400)]
        rows.append(" ".join(text))
    chain = [words[i] for i in rng.integers(0, 400, 60)]
    for k in range(12):
        chain[5 * k % 60] = f"c{k}"
        rows.append(" ".join(chain))
    rows += ["", None, "one", "ONE", "one two", " \n ", rows[0].upper(), rows[3]] * 2
    rows += [" ".join(words[i] for i in rng.integers(0, 400, 70)) for _ in range(60)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(spark, groups, size):
    docs = spark.createDataFrame([(*r, "x") for r in groups], "doc_id long, text string, cid string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.NearDuplicates(docs, size=size).result().collect()}
    assert got == components(groups, size)


def test_bounds_drop_only_unlikely_pairs():
    steps = [32, 64, 96, 128, 160]
    least = neardup.least_matches(steps, 0.8, 1e-6)
    assert all(m < 0.8 * n for m, n in zip(least, steps)) and least == sorted(least)
    rng = np.random.default_rng(2)
    runs = rng.random((20_000, 160)) < 0.8
    assert all((runs[:, :n].sum(axis=1) >= m).mean() > 0.9995 for m, n in zip(least, steps))


def test_one_row_of_each_group_stays(spark, odd_docs, groups):
    docs = spark.createDataFrame(groups, "doc_id long, text string")
    kept = {r.doc_id for r in neardup.kept_documents(docs, neardup.NearDuplicates(docs, size=2)).collect()}
    assert kept == {i for i, (_, c) in components(groups, 2).items() if i == c}
    odd = neardup.kept_documents(odd_docs, neardup.NearDuplicates(odd_docs, size=2))
    rows = odd.collect()
    assert odd.columns == odd_docs.columns
    assert sorted(Counter(str(r.doc_id) for r in rows).items()) == [("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 1), ("7", 2), ("None", 1)]
    assert neardup.NearDuplicates(odd_docs.limit(0)).result().count() == 0


def test_pipeline_stages_take_effect(spark, small):
    docs, seen = small["documents"], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        seen.append((name, docs.count(), out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = corpus_pipeline.written(out)
    assert len(seen) == 5 and all(b <= a for _, a, b in seen) and seen[0][1] > seen[-1][2] > 0
    ids = {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    final = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in final} == ids and all(r.text == texts[r.doc_id] for r in final)
    marks = {r.doc_id: r.quality for r in small["labels"].collect()}
    assert not [d for d in ids if marks.get(d) == 0 and len(texts[d]) > 400]


def test_pipeline_takes_odd_tables(spark, odd_docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        folder = "/root/testdata/sf0.001"
        assert stage(spark, odd_docs, folder).count() <= odd_docs.count(), name
        assert stage(spark, odd_docs.limit(0), folder).count() == 0, name
