import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillmark.llm import language, mixture, packing, queries, secrets, simhash, storage, surrogates

SF = "/root/testdata/sf0.001"
KEY = b"a key of the tests"

# ---- surrogates


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    p = surrogates.Permutation(b"k", "x", n)
    assert sorted(map(p.forward, range(n))) == list(range(n)) and [p.backward(p.forward(i)) for i in range(n)] == list(range(n))
    assert n == 1 or all(p.successor(i) != i for i in range(n))


def test_surrogates_keep_type_and_format():
    for kind, text in [
        ("email", "jane.doe-99@mail5.example.com"), ("phone", "+1 (743) 555-3824"), ("ip", "8.196.197.208"), ("national_id", "123-45-6789"), ("card", "4539 1488 0343 6467"), ("card", "4785380592391139"), ("person", "Анна Петрова"), ("person", "Maria Étienne"),
    ]:
        out = surrogates.surrogate(kind, text, KEY)
        assert out != text and out == surrogates.surrogate(kind, text, KEY) != surrogates.surrogate(kind, text, b"other key")
        if kind not in ("ip", "person"):
            assert len(out) == len(text) and all((a.isdigit(), a.isupper(), a.islower()) == (b.isdigit(), b.isupper(), b.islower()) for a, b in zip(text, out, strict=True))
        if kind == "card":
            assert surrogates.luhn(out.replace(" ", "")) == surrogates.luhn(text.replace(" ", ""))
        if kind == "person":
            assert all(a[-1] == b[-1] or b in surrogates.LISTED for a, b in zip(out.split(), text.split(), strict=True))
        else:
            assert [(s, e, k) for s, e, k in surrogates.find(f"x {out} y")] == [(2, 2 + len(out), kind)]
    iban = surrogates.surrogate("iban", "DE89 3704 0044 0532 0130 00", KEY).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_surrogates_are_distinct():
    rng = random.Random(1)
    ips = {f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(3)}.{rng.randrange(256)}" for _ in range(4000)}
    names = {a + b + "a" for a in ("Ann", "Ber", "Cla") for b in ("a", "e", "ik", "ul", "or")}
    for kind, values in (("ip", ips), ("person", names), ("phone", {f"+1 (555) 555-{i:04}" for i in range(3000)})):
        assert len({surrogates.surrogate(kind, v, KEY) for v in values}) == len(values)


def test_one_surrogate_for_every_writing():
    for kind, writings in {
        "card": ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
        "phone": ["+1 (555) 123-4567", "+1-555-123-4567", "(555) 123-4567", "555-123-4567"],
        "email": ["Jane.Doe@Mail.example.org", "jane.doe@mail.example.org"],
        "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    }.items():
        out = [surrogates.surrogate(kind, w, KEY) for w in writings]
        assert len({surrogates.canonical(kind, x) for x in out}) == 1
        shape = lambda t: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in t)
        assert kind == "iban" or [shape(x) for x in out] == [shape(w) for w in writings]


def test_names_keep_gender_and_script():
    for (script, gender), names in surrogates.GIVEN.items():
        own = names.split()
        images = [surrogates.name_word(w, KEY) for w in own]
        assert sorted(images) == sorted(own) and all(a != b for a, b in zip(own, images, strict=True)), (script, gender)
    text = "Anna Smith met Peter Jones; Anna Kowalska and the Summer School did not."
    out, entities = surrogates.replaced(text, KEY)
    assert [k for k, *_ in entities] == ["person"] * 3
    assert out.split()[0] == out.split("; ")[1].split()[0] != "Anna" and out.endswith("and the Summer School did not.")


EMAIL = re.compile(r"[\w%+](?:[\w.%+-]*[\w%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


@pytest.mark.parametrize("seed", range(200))
def test_emails_as_by_one_pattern(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("aZ9.-_+@@% ü.@xy") for _ in range(60)) + rng.choice(["", "@ab.de", ".a@b.cd.ef"])
    assert list(surrogates.emails(text)) == [m.span() for m in EMAIL.finditer(text)]


def test_mistyped_ibans_and_wide_letters(spark):
    """Entities that differ in check digits alone, or whose lower case is longer, have surrogates of their own."""
    ibans = [f"DE{c:02d}370400440532013000" for c in range(100)]
    out = [surrogates.surrogate("iban", x, KEY) for x in ibans]
    assert len(set(out)) == 100 and not set(out) & set(ibans) and len({x[4:] for x in out}) == 1
    assert int("".join(str(int(c, 36)) for c in out[89][4:] + out[89][:4])) % 97 == 1
    rows = [(1, "Pay DE89370400440532013000 or DE88370400440532013000"), (2, "İan@example.com and ǅo@b.org, STRAßE@b.org, Straße@b.org"), (3, "a" * 50_000 + "@" + "b" * 50_000 + "@c.de " + "9" * 50_000)]
    got = {r["doc_id"]: r for r in surrogates.pseudonymised_documents(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got[1]["n_iban"] == 2 and len(set(got[1]["text"].split()[1::2])) == 2
    assert got[2]["n_email"] == 4 and got[2]["text"].split(", ")[1].lower() == got[2]["text"].split(", ")[2].lower() and got[3]["n_email"] == 1


def brute_force(text):
    """All matches of all kinds, by kind and place, each kept if it meets none kept before."""
    kept = []
    for kind, pattern in (surrogates._PATTERNS | {"email": EMAIL}).items():
        for m in pattern.finditer(text or ""):
            s, e = m.span(m.lastindex) if kind == "person" else m.span()
            if all(e <= a or b <= s for a, b, _ in kept):
                kept.append((s, e, kind))
    return sorted(kept)


def test_op9_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.set("spark.rillmark.surrogateKey", "test")
    got = {r["doc_id"]: r for r in queries.op9_keyed_surrogates(spark, SF).collect()}
    key = hashlib.blake2b(b"0", key=surrogates.session_key(spark)[:64]).digest()
    rows = docs.collect()
    assert len(got) == len(rows) and sum(r["n_entities"] for r in got.values()) > 20
    for r in rows:
        spans, text = brute_force(r["text"]), r["text"]
        assert got[r["doc_id"]]["n_entities"] == len(spans)
        assert all(got[r["doc_id"]][f"n_{k}"] == sum(x == k for *_, x in spans) for k in surrogates.KINDS)
        for s, e, kind in reversed(spans):
            text = text[:s] + surrogates.surrogate(kind, text[s:e], key) + text[e:]
        assert got[r["doc_id"]]["text"] == text


def test_very_long_texts_are_linear():
    text = " ".join(f"a{i}@b.org 10.0.{i % 256}.{i // 256}" for i in range(20_000))
    began = time.perf_counter()
    assert len(surrogates.find(text)) == 40_000
    base = [(i, 0, i + 5) for i in range(0, 400_000, 10)]
    assert secrets.outside([(i + 5, 3, i + 9) for i in range(0, 400_000, 10)] + [(400_001, 3, 400_002)], base)[-1][0] == 400_001
    for run in ("a" * 10**6 + "@b", "@" * 10**6, "a." * 500_000 + "@", "9" * 10**6, "A1" * 500_000, "Anna " * 100_000, "DE44 " * 100_000):
        surrogates.find(f"x@ {run} 1")
    for run in ("1" * 10**6 + "x", "a" * 10**6 + "1b", "aB1" * 300_000, "a-" * 500_000 + "1", "Ab1_" * 250_000, "password " * 100_000, "0f" * 500_000 + "g"):
        secrets.random_spans(run, secrets.vocabulary(secrets.VOCABULARY))
        secrets.stated_spans(run)
    assert time.perf_counter() - began < 25


def test_identifiers_as_by_one_pattern():
    """Every string of five characters, against the pattern that states what an identifier is."""
    part = "(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,6})"
    whole = re.compile(f"{part}(?:[-_/=+]*{part})*[-_/=+]*")
    for n in range(1, 6):
        for letters in itertools.product("aB1-", repeat=n):
            run = "".join(letters)
            assert secrets.is_identifier(run) == bool(whole.fullmatch(run)), run


def test_a_key_is_needed(spark):
    with pytest.raises(TypeError):
        surrogates.surrogate("ip", "1.2.3.4")
    spark.conf.unset("spark.rillmark.surrogateKey")
    assert surrogates.session_key(spark) == surrogates.session_key(spark)


def test_documents(spark):
    text = "Mrs Anna Smith wrote from x.72@mail3.example.com, +1 (729) 555-7725 190.55.3.2 and 4952935900253052$$$ to Mr. Smith"
    clean = "Version 4.0. of 12345 in 1eb9c654e721b4f812088970e66a6345cee33dd6; see 3.14 and 2.0.1"
    docs = spark.createDataFrame([(1, text, 5), (2, clean, 6), (3, None, 7), (None, "", 8), (1, text, 5)], "doc_id long, text string, n_email int")
    rows = surrogates.pseudonymised_documents(docs, KEY).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 5 and got[2]["text"] == clean and got[3]["text"] is None and got[None]["text"] == ""
    one = got[1]
    assert (one["n_email"], one["n_phone"], one["n_ip"], one["n_card"], one["n_person"]) == (1, 1, 1, 1, 2)
    for value in ("Anna", "Smith", "x.72@", "555-7725", "190.55.3.2", "4952935900253052"):
        assert value not in one["text"]
    assert one["text"].startswith("Mrs ") and one["text"].split()[2] == one["text"].split()[-1]
    assert surrogates.pseudonymised_documents(docs.limit(0), KEY).count() == 0


def test_shared_surrogates_are_found(spark):
    rows = [([("ip", "a", "z"), ("ip", "b", "z")],), ([("ip", "a", "z"), ("phone", "c", "z")],)]
    found = surrogates.check_distinct(spark.createDataFrame(rows, "pii_entities array<struct<kind:string,entity:string,surrogate:string>>")).collect()
    assert [tuple(r) for r in found] == [("ip", "z", 2)]


# ---- mixture


def test_raking_meets_targets():
    rng = np.random.default_rng(0)
    codes = np.array([(i, j, k) for i in range(4) for j in range(3) for k in range(2)]).T
    cells = rng.uniform(1, 100, codes.shape[1])
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.9, 0.1])]
    mass = cells / cells.sum() * mixture.rake(cells, codes, targets)
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, mass), target, atol=1e-6)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.7, 1.0])
def test_rate_keeps_the_share(share):
    rng = np.random.default_rng(3)
    f, t = rng.uniform(0.01, 5, 50), rng.integers(1, 1000, 50)
    r = mixture.rate(f, t, share * t.sum())
    assert (np.minimum(1, r * f) * t).sum() == pytest.approx(share * t.sum())


def test_both_ways_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    targets = {"lang": {"en": 0.5, "fr": 0.5, "xx": 3.0}}
    one, two = (mixture.mix(docs, targets, cells_most=n, rounds=3).select("doc_id", "probability", "kept", "weight") for n in (10**6, 0))
    a, b = ({r["doc_id"]: r for r in x.collect()} for x in (one, two))
    assert a.keys() == b.keys() and len(a) == 200
    assert all(a[k]["probability"] == pytest.approx(b[k]["probability"], abs=1e-6) for k in a)
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(a[k]["probability"] == 0 and not a[k]["kept"] for k in a if langs[k] not in ("en", "fr"))


def test_mixture_matches_brute_force(spark):
    rows = mixture.mixed_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["n_tokens"] == len(docs[r["doc_id"]]["text"].split()) for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    axes = ("source", "lang", "topic")
    mass = {}
    for r in rows:
        key = tuple(r[a] for a in axes)
        mass[key] = mass.get(key, 0) + r["n_tokens"] / total
    share = [{v: sum(m for k, m in mass.items() if k[i] == v) for v in {k[i] for k in mass}} for i in range(3)]
    want = [{v: s**0.5 / sum(x**0.5 for x in by.values()) for v, s in by.items()} for by in share]
    factor = dict.fromkeys(mass, 1.0)
    for _ in range(50):
        for i in range(3):
            now = {}
            for k in mass:
                now[k[i]] = now.get(k[i], 0) + mass[k] * factor[k]
            factor = {k: f * want[i][k[i]] / now[k[i]] for k, f in factor.items()}
    assert all(r["weight"] == pytest.approx(factor[tuple(r[a] for a in axes)], rel=1e-6) for r in rows)
    assert sum(r["probability"] * r["n_tokens"] for r in rows) == pytest.approx(total / 2, rel=1e-6)
    assert abs(sum(r["n_tokens"] for r in rows if r["kept"]) / total - 0.5) < 0.15


def test_mixture_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, "k"), (2, "", "en", "s", "k"), (None, " a  b\n", "en", "s", "k"), (3, "one", "en", None, "k"), (3, "one", "en", None, "k")], "doc_id long, text string, lang string, source string, kept string")
    got = mixture.mix(docs).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [0, 0, 1, 1, 2] and all(isinstance(r["kept"], bool) for r in got)
    assert mixture.mix(docs.limit(0)).count() == 0


# ---- language


def test_pages_are_judged_right(spark):
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(pages, docs).collect()
    truth = {r["page_id"]: r["url"].split("/")[3] for r in pages.collect()}
    assert len(rows) == len(truth) and np.mean([r["lang"] == truth[r["page_id"]] for r in rows]) > 0.97
    assert all(sum(r["posterior"]) == pytest.approx(1) and max(r["posterior"]) == pytest.approx(r["probability"]) for r in rows)


def test_page_text():
    assert language.page_text("<p>a<script>b</script>c<!-- d -->e<nav>f").split() == ["a", "c", "e", "f"]
    assert language.page_text("a <NAV x='1'>b</nav > c <b>d") .split() == ["a", "c", "d"]
    assert language.page_text(None) == "" and language.page_text("1 < 2 &amp; 3") == "1 < 2 & 3"
    began = time.perf_counter()
    language.page_text("<nav>" * 50_000 + "<" * 50_000)
    assert time.perf_counter() - began < 5


def test_every_label_is_a_language(spark):
    docs = spark.createDataFrame([("the and", "en")] * 3000 + [("zzz qqq", "xx"), ("y" * 50_000, "long")], "text string, lang string")
    assert language.fit(docs, sample=50).langs == ["en", "long", "xx"]


def test_fusion_matches_brute_force(spark):
    docs = spark.createDataFrame([("la le les une des", "fr"), ("the and of was with", "en")], "text string, lang string")
    raw = [(1, "http://a.x.fr/1", "<html lang=fr>la le une"), (2, "http://a.x.fr/2", "<html lang=en>les des"), (3, "http://b.x.fr/", "<html lang=en>"), (4, None, None), (5, "HTTP://u@c.com:80/", "<HTML xml:lang='en-GB'>the of &amp; was"), (None, "odd", ""), (5, "HTTP://u@c.com:80/", "<HTML xml:lang='en-GB'>the of &amp; was")]
    pages = spark.createDataFrame([(*r, "x") for r in raw], "page_id long, url string, html string, prior string")
    rows = language.identify(pages, docs).collect()
    model = language.fit(docs)
    seen = []
    for pid, url, html in raw:
        ll = model.of(language.page_text(html), {})
        host = {"http://a.x.fr/1": "a.x.fr", "http://a.x.fr/2": "a.x.fr", "http://b.x.fr/": "b.x.fr", "HTTP://u@c.com:80/": "c.com"}.get(url, "")
        p = np.exp(ll - ll.max())
        seen.append((pid, host, ".".join(host.split(".")[-2:]) if "." in host else "", host.rpartition(".")[2] if "." in host else "", language.declared(html), ll, p / p.sum()))
    want = []
    for at, s in enumerate(seen):
        rest = [x for i, x in enumerate(seen) if i != at]  # no page votes for itself
        prior = np.full(2, 0.5)
        for same in (lambda x: True, lambda x, s=s: x[3] == s[3], lambda x, s=s: x[2] == s[2] and x[3] == s[3], lambda x, s=s: x[1] == s[1]):
            c = sum((x[6] for x in rest if same(x)), np.zeros(2))
            prior = (c + language.STRENGTH * prior) / (c.sum() + language.STRENGTH)
        marks = sum((x[6] for x in rest if x[4] == s[4]), np.zeros(2))
        logs = s[5] + np.log((marks + 0.1) / (sum(x[6] for x in rest) + 1.0)) + np.log(prior)
        p = np.exp(logs - logs.max())
        want.append((s[0] or 0, [round(x, 6) for x in p / p.sum()]))
    assert sorted((r["page_id"] or 0, [round(x, 6) for x in r["posterior"]]) for r in rows) == sorted(want)
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in language.identify(pages, docs.limit(0)).collect()} == {None}


# ---- pipeline


def jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_deduplicated_keeps_one_of_each(spark):
    rows = [(5, "same text here", 1, "a"), (3, "SAME  text here", 2, "b"), (3, "same text here", 2, "b"), (None, "other words entirely", 4, "c"), (None, "other words entirely", 4, "c"), (9, None, 5, "d"), (8, " ", 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int, node string")
    got = simhash.deduplicated(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 3), (False, 8), (True, 0)]
    assert got[0].asDict().keys() == {"doc_id", "text", "root", "node"}
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_near_copies_are_found_and_others_kept(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for base in range(60):
        words = rng.choices(vocabulary, k=rng.choice([30, 130, 500, 2500]))
        words[5:5] = passage if base % 3 == 0 else []
        texts.append(words)
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(words)
            for i in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([30, 60, 150]))):
                copy[i] = rng.choice(vocabulary)
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                old, new = root[i], root[j]
                root = [min(old, new) if r in (old, new) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert got == set(root) and len(got) < len(texts) - 20


def test_stages_return_clashing_columns_unchanged(spark):
    names = ["score", "predicted", "held_out", "weight", "probability", "kept", "n_tokens", "topic", "pii_entities", "__row", "__same", "__text", "row", "__column0"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", None, 0), (None, "x" * 300_000, "en", "s", 1), (9003, "twice", "en", "s", 5), (9003, "twice", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    docs = storage.staged(docs, "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == (None if r["doc_id"] is None else f"{i}:{r['doc_id']}") for r in rows for i, n in enumerate(names)), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.01").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01").collect()
    assert len({(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed if r["doc_id"] != 9003}) == sum(r["doc_id"] != 9003 for r in packed)
    assert sum(r["doc_id"] == 9003 for r in packed) == 2


def test_stages(spark):
    sf = "/root/testdata/sf0.01"  # the smallest has too few labels for a document to be rejected
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = storage.staged(stage(spark, docs, sf), "test")
        after = docs.collect()
        assert docs.columns == columns and {r["doc_id"] for r in after} <= before.keys()
        if name == "SimHash near-dedup":
            assert len({" ".join(r["text"].lower().split()) for r in after}) == len(after)
        if name == "PII":
            assert all(not any(r["text"][s:e] == before[r["doc_id"]]["text"][s:e] for s, e, _ in surrogates.find(before[r["doc_id"]]["text"])) for r in after)
        counts.append(len(after))
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()} and all(r["offset"] + r["length"] <= packing.CAPACITY for r in packed)
    run = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, run)) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    assert zlib.crc32(b"") == 0
