"""Operators against brute force on small tables with nulls, empties, ties, repeated rows and clashing column names."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from netloom.llm import op1_substring, op2_mixing, op3_fingerprint, op4_media, op5_ppm, op6_pii, op7_jaccard, op8_packing, op9_sharding, op10_quality
from netloom.llm.common import components, run_hash, sliding
from netloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, `__row` string, key string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["The", "cat", "sat", "é", "naïve", "x,", "42", "on", "mat"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = make(60)
    out = [(k, make(rng.randrange(3, 120))) for k in range(30)]
    out += [(30, shared), (31, make(20) + "\n" + shared + "\t" + make(9)), (32, shared), (33, None), (34, ""), (35, " \n\t"), (36, make(9000)), (None, "no id"), (37, "two words"), (38, "two words"), (39, "one"), (39, "one"), (40, make(40) * 2)]
    near = make(100).split()
    for k in range(8):
        out.append((50 + k, " ".join(near[:k] + ["changed"] + near[k + 1 :])))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(k, t, "en", None if n % 7 == 3 else f"s{n % 4}", len(t or ""), 1, 2, "r", "k") for n, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_helpers(spark):
    x = np.arange(1, 50, dtype=np.uint64) * np.uint64(977)
    for w in (1, 2, 3, 8, 35):
        want = [sum(int(v) * pow(31, w - 1 - n, 1 << 64) for n, v in enumerate(x[p : p + w])) % (1 << 64) for p in range(len(x) - w + 1)]
        assert run_hash(x, w, 31).tolist() == want
        assert sliding(np.minimum, x[::-1], w).tolist() == [int(x[::-1][p : p + w].min()) for p in range(len(x) - w + 1)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (7, 3), (20, 9)], "a long, b long")
    assert by(components(edges), "id", "root") == sorted([(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8), (20, 8)], key=str)


def test_op1(docs, rows, none):
    split = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for (k, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert by(op1_substring.dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    out = op1_substring.dedup(docs, text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out) and len(out) == len(rows)
    assert op1_substring.dedup(none).count() == 0


def test_op1_index_takes_batch_after_batch(docs, rows, spark, tmp_path):
    """Three batches into an index that is opened anew each time: each is judged against all that came before it."""
    schema, path, before = "doc_id long, text string", f"file://{tmp_path}/index", []
    for k, part in enumerate((rows[:31], rows[31:38], rows[38:])):
        index = op1_substring.FingerprintIndex(spark, path)
        assert len(index.runs) == min(k, 1) and index.state["made"] == (0, 1, 3)[k]
        seen = spark.createDataFrame(before, schema) if before else None
        got = by(op1_substring.dedup(spark.createDataFrame(part, schema), batches=1, index=index, seen=seen), "doc_id", "n_words", "n_removed", "kept_sha256")
        both = before + part
        split = [(t or "").encode().split() for _, t in both]
        count = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
        want = []
        for (d, _), w in list(zip(both, split))[len(before) :]:
            gone = [False] * len(w)
            for i in range(len(w) - 34):
                if count[tuple(w[i : i + 35])] > 1:
                    gone[i : i + 35] = [True] * 35
            want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
        assert got == sorted(want, key=str)
        before = both
    index = op1_substring.FingerprintIndex(spark, path)
    held = {r.hash: r.n for r in index.run(index.runs[0]).collect()}
    texts = {t for _, t in rows if t}
    plain = collections.Counter()
    for part in (rows[:31], rows[31:38], rows[38:]):
        for t in {t or "" for _, t in part}:
            values, n = op1_substring.minimizers(op1_substring.hashes(t.encode().split()), 35, 8)
            plain.update({int(v): 1 + int(c > 1) for v, c in zip(values.view(np.int64), n)})
    assert held == dict(plain) and texts
    repeated = index.ingest(spark.createDataFrame([(h, 1) for h in list(held)[:3]] + [(5, 1), (6, 2)], "hash long, n long"))
    assert {r.hash for r in repeated.collect()} == {*list(held)[:3], 6}
    plan = index.run(index.runs[0]).join(index.run(index.runs[0]).hint("merge"), "hash")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()


def test_op2(docs, rows, none):
    out = op2_mixing.mix(docs).collect()
    again = op2_mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    total = sum(len((t or "").encode().split()) for _, t in rows)
    assert sum(r["size"] for r in out) == total
    biggest = max(r["size"] for r in out)
    source = {}
    for r in out:
        source.setdefault(r.source_size, [r.target, 0])[1] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(t <= 3 * s + 1e-6 and abs(taken - t) <= biggest for s, (t, taken) in source.items())
    assert op2_mixing.share_out([100, 100, 1], [1, 1, 8]) == pytest.approx([99, 99, 3])
    assert op2_mixing.share_out([0, 0], [1, 2]) == [0, 0]
    mixed = op2_mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert op2_mixing.mix(none).count() == 0 and op2_mixing.mixed_rows(none).count() == 0


def test_op3(docs, rows, none, spark):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for n, (k, t) in enumerate(order):
        nxt, half = order[(n + 1) % len(order)][1], len(t) // 2
        want.append((k, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert by(op3_fingerprint.edited_report(docs), "doc_id", "n_chars", "edited_sha256") == sorted(want, key=str)
    small = op3_fingerprint.with_next(docs, rows_per_range=4).select("doc_id", "text", "next_text").collect()
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in small) == sorted((str(k), t, order[(n + 1) % len(order)][1]) for n, (k, t) in enumerate(order))
    same = spark.createDataFrame([("É  Ｆoo Straße\n",), ("é foo strasse",), (None,), ("other",)], "text string")
    prints = [r.fingerprint for r in op3_fingerprint.fingerprints(same).orderBy(F.desc("text")).collect()]
    assert len(set(prints)) == 3
    assert op3_fingerprint.edited_report(none).count() == 0


def test_op3_compares_bytes_inside_equal_buckets(spark, docs, rows, none, monkeypatch):
    plain = {(r.doc_id, r.text): r.fingerprint for r in op3_fingerprint.fingerprints(docs).collect()}
    report = by(op3_fingerprint.edited_report(docs), "doc_id", "n_chars", "edited_sha256")
    monkeypatch.setattr(op3_fingerprint, "wide_key", lambda c: (F.length(c).cast("long") % 2, F.lit(7).cast("long")))
    clashing = op3_fingerprint.fingerprints(docs.withColumn("fingerprint", F.lit("old")))
    assert clashing.columns == [*docs.columns, "fingerprint"]
    odd = {(r.doc_id, r.text): r.fingerprint for r in clashing.collect()}
    assert len(odd) == len(plain) and all((odd[a] == odd[b]) == (plain[a] == plain[b]) for a in odd for b in odd)
    out = op3_fingerprint.edited_report(docs)
    assert by(out, "doc_id", "n_chars", "edited_sha256") == report
    texts = collections.defaultdict(list)
    for k, t in rows:
        texts[k].append(t or "")
    prints = {}
    for r in out.collect():
        prints.setdefault(r.fingerprint, set()).update(x.lower().strip() for x in texts[r.doc_id] if len(texts[r.doc_id]) == 1)
    assert all(len({" ".join(x.split()) for x in v}) <= 1 for v in prints.values())
    assert all(r.fingerprint.count("-") == 1 and len(r.fingerprint) == 97 for r in out.collect())


def test_op4(docs, rows, none, spark, tmp_path):
    got = {}
    for r in op4_media.media_report(docs).collect():
        got.setdefault(r.payload_sha256, r)
    for _, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        r = got[hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert op4_media.decode(op4_media.encode(payload)) == payload and r.media_bytes == len(op4_media.encode(payload))
    assert op4_media.media_report(docs).count() == len(rows) and op4_media.media_report(none).count() == 0
    # A damaged member is retried alone and reported alone.
    path = f"file://{tmp_path}/a"
    op4_media.write_archives(docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("payload")).where("text is not null").coalesce(1), path)
    file = next((tmp_path / "a").glob("*.zip"))
    import zipfile

    assert zipfile.ZipFile(file).testzip() is None
    raw = bytearray(file.read_bytes())
    raw[60] ^= 255
    file.write_bytes(raw)
    out = op4_media.read_archives(spark, path, on_error="row", range_bytes=4096).collect()
    assert len(out) == len(rows) - 1 and sum(r.error is not None for r in out) == 1


def test_op5(docs, rows, none):
    split = [(t or "").encode().lower().split() for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = collections.Counter(x for w, h in zip(split, held) if not h for x in [*w, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for (k, _), w, h in zip(rows, split, held))
    for head in (10, 1_000_000):
        out = op5_ppm.ppm_scores(docs, head=head).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
        assert all(r.score < 0 for r in out)
    assert op5_ppm.ppm_scores(none).count() == 0


def test_ppm_is_a_distribution_and_matches_a_plain_trie():
    texts = [b"abracadabra", b"abba", b"", b"cabal"]
    code = op5_ppm.grams(texts)[0]
    levels = []
    for k in range(op5_ppm.ORDER + 1):
        g, c = op5_ppm.tally(code & np.uint64((1 << 8 * (k + 1)) - 1))
        levels.append((g, c.astype(np.int64)))
    trie = op5_ppm.Trie(levels)
    counts = collections.defaultdict(collections.Counter)
    pad = op5_ppm.START
    for t in texts:
        full = pad + t + op5_ppm.END
        for i in range(len(pad), len(full)):
            for k in range(op5_ppm.ORDER + 1):
                counts[full[i - k : i]][full[i]] += 1

    def plain(context: bytes, symbol: int) -> float:
        p, out = 1.0, set()
        for k in range(op5_ppm.ORDER, -1, -1):
            seen = {s: n for s, n in counts.get(context[len(context) - k :], {}).items() if s not in out}
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if symbol in seen:
                return p * seen[symbol] / (total + kinds)
            p *= kinds / (total + kinds)
            out |= set(seen)
        return p / (256 - len(out))

    for context in (pad, b"cabra", b"zzzzz", b"xxabr", pad[:3] + b"ab"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        p = 10 ** trie.log10(codes)
        assert p.sum() == pytest.approx(1.0)
        assert p.tolist() == pytest.approx([plain(context, s) for s in range(256)])


def test_op5_scores_by_the_whole_trie(docs, rows):
    texts = [(t or "").encode() for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    code = op5_ppm.grams([t for t, h in zip(texts, held) if not h])[0]
    trie = op5_ppm.Trie([op5_ppm.tally(code & np.uint64((1 << 8 * (k + 1)) - 1)) for k in range(op5_ppm.ORDER + 1)])
    want = sorted((str(k), round(float(trie.log10(op5_ppm.grams([t])[0]).sum()), 6)) for (k, _), t in zip(rows, texts))
    for most in (1, 100, 3_000_000):
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in op5_ppm.ppm_scores(docs, max_nodes=most).collect()) == want


def test_op6(docs, none, spark, rows):
    text = "Mr John Smith met Mrs. Ana Lopez; call +1 (212) 555-1234 or jo.x@mail.example.com, JO.X@mail.example.com, from 10.0.0.7, card 4111 1111 1111 1111, not 4111111111111112, ssn 123-45-6789, token = \"" + "0a" * 20 + '"'
    data = [(1, text, "a"), (2, text, "b"), (3, "call +1 (212) 555-1234 and +1 (212) 555-1235", None), (4, None, "n"), (5, "", "e"), (6, "clean 12 3.5 text 2024-01-02", "c")]
    out = {r.doc_id: r for r in op6_pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string, kind string")).collect()}
    assert out[4].text is None and out[5].text == "" and out[6].text == data[5][1] and out[1].kind == "a"
    for gone in ("Smith", "Lopez", "555-1234", "jo.x@", "10.0.0.7", "4111 1111 1111 1111", "123-45-6789", "0a0a"):
        assert gone not in out[1].text
    assert "4111111111111112" in out[1].text and out[1].text == out[2].text and out[1].n_entities == 9
    assert out[1].text.startswith("Mr ") and out[1].text.split()[1] in op6_pii.MALE and "Mrs. " + out[1].text.split("Mrs. ")[1].split()[0] in [f"Mrs. {f}" for f in op6_pii.FEMALE]
    first, second = (w for w in __import__("re").findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[3].text))
    assert first != second and first in out[1].text
    low, high = __import__("re").findall(r"(?i)\b[a-z.]+@[a-z.]+", out[1].text)
    assert low.lower() == high.lower() and high.split("@")[0].isupper()
    assert op6_pii.replace_pii(docs).count() == len(rows) and op6_pii.replace_pii(none).count() == 0
    assert op6_pii.replace_pii(docs).columns == [*docs.columns, "n_entities"]


def test_op6_adjacent_entities(spark):
    phone, ip, card, ssn = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "123-45-6789"
    cases = [
        (f"{phone} {ip}", [phone, ip]), (f"{ip} {phone}", [ip, phone]), (f"at {phone} 2024", [phone]), (f"+44 20 7946 0958 {ssn}", ["7946 0958", ssn]), (f"+44 20 7946 0958 {card}", ["7946 0958", card]),
        (f"card {card} 123", [card]), ("4111111111111111 12/26", ["4111111111111111"]), (f"1234 5678 {card}", [card]), (f"1700000000000 {ip}", [ip]), (f"{card} {card[:-1]}2", [card + " "]),
        (f"{ssn} {card} {ip}", [ssn, card, ip]), ("Mr Smith Mr Jones", ["Smith", "Jones"]), ("Mr Smith@mail.com", ["Smith", "mail"]), ("3782 822463 10005, 378282246310005", ["822463", "8282246"]), ("x" * 9, []), (phone, [phone]),
    ]
    out = {r.n: r for r in op6_pii.replace_pii(spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, text string")).collect()}
    for n, (text, gone) in enumerate(cases):
        assert not [g for g in gone if g in out[n].text], (text, out[n].text)
    new = out[15].text
    assert out[0].text.startswith(new + " ") and out[1].text.endswith(" " + new) and out[2].text == f"at {new} 2024"
    assert out[5].text.endswith(" 123") and out[6].text.endswith(" 12/26") and out[7].text.startswith("1234 5678 ") and out[9].text.endswith(" 4111 1111 1111 1112") and out[8].text.startswith("1700000000000 ")
    assert [out[n].n_entities for n in (0, 2, 7, 10, 11, 14)] == [2, 1, 1, 3, 2, 0]


def test_op6_all_scripts_and_many_names(spark):
    import re

    mails = ["张伟@例子.公司", "张伟@example.com", "محمد@مثال.com", "हिन्दी@उदाहरण.com", "김철수@예시.kr", "ⴰⴱⴳ@x.org", "١٢@y.org", "-@-.-", "_@x.org", *(f"{c}@z.org" for c in "abcdefghijklmnopqrstuvwxyz0123456789")]
    digit = lambda n: "".join(chr(97 + int(c)) for c in f"{n:05d}")
    names = ["Mr Иванов", "Mrs Анна Иванова", "Ms Ζωή Παππά", *(f"Mr Q{digit(n)}" for n in range(4500))]
    out = {r.n: r for r in op6_pii.replace_pii(spark.createDataFrame(list(enumerate(mails + names)), "n int, text string")).collect()}
    new = [out[n].text for n in range(len(out))]
    assert all(r.n_entities == 1 for r in out.values()) and len(set(new)) == len(new) and not set(new) & set(mails + names)
    for old, now in zip(mails, new):
        local, host = old.rsplit(".", 1)[0].split("@")
        assert local not in now.split("@")[0] and host != now.rsplit(".", 1)[0].split("@")[1] and now.endswith("." + old.rsplit(".", 1)[1]), (old, now)
    assert re.fullmatch("[一-鿿]{2,}@[一-鿿]{2}.公司", new[0]) and re.fullmatch("[ء-ي]{4,}@[ء-ي]{4}.com", new[2]) and re.fullmatch("[ऀ-ॿ]{6,}@[ऀ-ॿ]{6,}.com", new[3]) and re.fullmatch("[가-힣]{3,}@[가-힣]{2}.kr", new[4])
    assert all(re.fullmatch("Mrs? [А-Я][а-я]+( [А-Я][а-я]+)?", x) for x in new[len(mails) : len(mails) + 2]) and re.fullmatch("Mr [A-Z][a-z]+", new[-1])


def test_op6_every_match_implies_the_hint(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    secrets = [f"key sk-{letters} end", "AKIA" + letters[:16].upper(), *(f"gh{c}_{letters}{letters[:10]}" for c in "pousr"), "ab" * 16, "AB" * 16]
    texts = [*secrets, "a@b.cd", "+49 30 1234 567", "1.2.3.4", "123-45-6789", "4111111111111111", *(f"{x} Abc" for x in op6_pii.TITLES.split("|")), *(f"{x}. Abc" for x in op6_pii.TITLES.split("|"))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(F.col("text").rlike(op6_pii.ANY) & F.col("text").rlike(op6_pii.HINT)).count() == len(texts)
    out = [r.text for r in op6_pii.replace_pii(df.limit(len(secrets))).collect()]
    assert not set(out) & set(texts) and len(set(out)) == len(secrets)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_op7(docs, rows, none, k, num):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for n, (d, _) in enumerate(rows):
        if d is not None:
            least[root(n)] = min(d, least.get(root(n), d))
    want = sorted((str(d), len(s), str(least.get(root(n)))) for n, ((d, _), s) in enumerate(zip(rows, sets)))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op7_jaccard.jaccard_components(docs, k, num, 100).collect()) == want
    blocks = op7_jaccard.linked_rows(docs, k, num, 100, block_sets=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in blocks) == want
    groups = len({root(n) for n in range(len(sets)) if sets[n]}) + sum(not s for s in sets)
    kept = op7_jaccard.keep_one(docs, k, num, 100)
    assert kept.count() == groups and kept.columns == docs.columns
    assert op7_jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize(("num", "seed"), [(90, 1), (80, 2), (80, 3), (50, 4)])
def test_op7_links_of_a_block(num, seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 62, 60) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.permutation(base[k % 4])[: rng.integers(40, 61)], rng.integers(0, 1 << 62, rng.integers(0, 12)), base[3][:10]])).astype(np.uint64) for k in range(160)]
    for blocks in ([0] * len(sets), [k % 2 for k in range(len(sets))]):
        near = lambda a, b: 100 * len(set(a) & set(b)) >= num * len(set(a) | set(b))
        up = list(range(len(sets)))
        root = lambda x: x if up[x] == x else root(up[x])
        for a in range(len(sets)):
            for b in range(a):
                if near(sets[a], sets[b]) and (len(set(blocks)) == 1 or blocks[a] != blocks[b]):
                    up[root(a)] = root(b)
        want, found = [root(x) for x in range(len(sets))], op7_jaccard.link(sets, blocks, num, 100)
        assert all(near(sets[a], sets[b]) for a, b in found) and len(found) == len(sets) - len(set(want))
        up = list(range(len(sets)))
        for a, b in found:
            up[root(a)] = root(b)
        got = [root(x) for x in range(len(sets))]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_op8(docs, rows, none):
    from tokenizers import Tokenizer

    out = op8_packing.pack_documents(docs, tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    parts = collections.defaultdict(list)
    for r in out:
        parts[str(r.doc_id)].append((r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for k, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        for a, b in zip([0, *range(head, len(ids), 1024)], range(head, len(ids) + 1, 1024)):
            want[str(k)].append((a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= -(-sum(r.length for r in out) // 1024) + 1
    packed = op8_packing.sequences(docs, tokenizer_path()).collect()
    assert sum(len(r.ids) for r in packed) == sum(r.length for r in out)
    assert op8_packing.pack_documents(none, tokenizer_path()).count() == 0
    for seed in range(5):
        rng = np.random.default_rng(seed)
        h = collections.Counter(rng.integers(1, 65, 300).tolist())
        got = op8_packing.plan(h, 64)
        spent = collections.Counter()
        for p, n in got:
            assert sum(p) <= 64
            for x in p:
                spent[x] += n
        assert spent == h
        plain = op8_packing.best_fit(sorted(((k, n) for k, n in h.items()), reverse=True), 64)
        assert sum(n for _, n in got) <= 1.03 * sum(n for _, n in plain)
    odd = "a​b <|endoftext|> \x1c 　 日本 \x85 '’s don't  \n\n x"
    assert op8_packing.Ids(tokenizer_path())(odd) == np.array(tok.encode(odd, add_special_tokens=False).ids, "<u4").tobytes()
    assert struct.calcsize("<I") == 4


def test_op9(docs, rows, none, spark, tmp_path):
    out = op9_sharding.assign_shards(docs).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    by_shard = collections.defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    sums = collections.Counter()
    for r in op9_sharding.assign_shards(hot, rows_per_range=100).collect():
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.03 * max(sums.values()) and len(sums) == 8
    op9_sharding.write_shards(docs.select("doc_id", "text"), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(rows)
    assert op9_sharding.assign_shards(none).count() == 0


def test_op9_keeps_small_groups_whole_in_many_ranges(spark):
    copies = spark.range(3996).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of group "), F.lpad((F.col("id") % 444).cast("string"), 3, "0")).alias("text"))
    out = op9_sharding.assign_shards(copies, rows_per_range=2).collect()
    found = collections.defaultdict(set)
    for r in out:
        found[r.text_crc32].add(r.shard)
    assert len(out) == 3996 and len(found) == 444 and all(len(s) == 1 for s in found.values())
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - 3996 / 8) < 12


def test_op10(spark, none, docs, rows):
    d, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = op10_quality.quality_report(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    kept = op10_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    no = labels.where("false")
    assert {r.score for r in op10_quality.quality_report(docs, no).collect()} == {0.5}
    assert op10_quality.quality_report(none, labels).count() == 0


def test_columns_of_the_results_names_are_replaced(spark, docs):
    odd = docs.withColumns({"n_entities": F.lit("old"), "score": F.lit("old"), "predicted": F.lit("old")})
    out = op6_pii.replace_pii(odd)
    assert sorted(out.columns) == sorted(odd.columns) and dict(out.dtypes)["n_entities"] == "int"
    scored = op10_quality.score_quality(odd, op10_quality.Voters([], np.zeros(0), 16, 4, 3))
    assert sorted(scored.columns) == sorted(odd.columns) and {r.score for r in scored.collect()} == {0.5}


def test_op8_finds_every_exact_filling():
    """Where some four lengths or fewer fill a sequence, the first pattern of the plan does."""
    import itertools

    for seed in range(60):
        rng = np.random.default_rng(seed)
        h = collections.Counter(rng.integers(1, 40, 7).tolist())
        items = list(h.elements())
        exact = any(sum(c) == 40 and max(items) in c for k in range(1, 5) for c in itertools.combinations(items, k))
        assert any(sum(p) == 40 for p, _ in op8_packing.plan(h, 40)) or not exact


def test_op8_cache_changes_no_id():
    texts = ["one two three two one " * 5, "grün  \n und blau", "", "a1b2c3 ..."]
    full, small = op8_packing.Ids(tokenizer_path()), op8_packing.Ids(tokenizer_path(), 2)
    assert [full(t) for t in texts] == [small(t) for t in texts] and len(small) == 2 < len(full)
