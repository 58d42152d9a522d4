"""Operators 2 and 5 to 10 and the pipeline: brute force, round trips, held-out accuracy, edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vaultql.llm import pieces, pii, queries, warc
from vaultql.llm.language import LanguageModel, identify_language, learn_languages
from vaultql.llm.quality import learn_quality, score_quality
from vaultql.llm.rules import clean_lines
from vaultql.llm.toxicity import learn_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (3, "word", "x"), (None, "word", None), (3, "word", "x"), (4, "😀 ▁ é\x00\n\n | a | b", "x"), (5, "a" * 60_000 + " b" * 5_000, "x")]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language(spark, odd):
    got = queries.language(spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    model = learn_languages(table(spark, "documents"))
    found = {r.doc_id: (r.lang_pred, r.rejected) for r in identify_language(odd, model).collect()}
    assert found[1] == found[2] == ("und", True) and found[3][0] in model.dictionaries
    assert learn_languages(odd.withColumn("lang", F.lit(None).cast("string"))).dictionaries == {}
    assert identify_language(odd, LanguageModel({})).where("lang_pred = 'und'").count() == len(ODD)


def test_toxicity(spark, odd):
    got = queries.toxicity(spark, SF).join(table(spark, "labels"), "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.85
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = learn_toxicity(odd, empty)
    assert all(0 <= r.score <= 1 for r in score_toxicity(odd, model).collect())


def test_factorization_learns_pairs_that_additive_weights_miss():
    import numpy as np

    from vaultql.llm import toxicity as T

    def made(seed, n, fill):
        rng, known = random.Random(seed), T._Known(None)
        texts = [" ".join(["foo"] * (k & 1) + ["bar"] * (k >> 1 & 1) + rng.choices(fill, k=5)) for k in range(n)]
        return [T.counted(t, known) for t in texts], np.array([("foo" in t) == ("bar" in t) for t in texts]).astype(int)

    def right(model, rows, labels):
        scores = [model.score(np.searchsorted(model.wanted, i[np.isin(i, model.wanted)]), T.values(n[np.isin(i, model.wanted)], w)) for i, n, w in rows]
        return ((np.array(scores) >= 0.5) == labels).mean()

    for fill in (["one", "two", "six"], [f"x{c}" for c in "abcdefghijklmnop"]):
        (rows, labels), (new, truth) = made(1, 600, fill), made(2, 200, fill)
        model = T.fit(rows, labels, np.ones(600), epochs=300, rate=0.1)
        assert {t for w in ("foo", "bar") for t in T.terms(w)} <= set(model.wanted.tolist())
        assert right(model, new, truth) > 0.95
        additive = T.fit(rows, labels, np.ones(600), epochs=300, rate=0.1, rank=1)
        additive.factors[:] = 0
        assert right(additive, new, truth) < 0.7


def test_rare_insults_are_learned_in_large_samples_too():
    import numpy as np

    from vaultql.llm import toxicity as T

    for size in (600, 8000):
        rng, known = random.Random(3), T._Known(None)
        fill = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
        texts = [" ".join(rng.choices(fill, k=12) + ["slur"] * (k < 20)) for k in range(size)]
        rows, labels = [T.counted(t, known) for t in texts], np.array([k < 20 for k in range(size)]).astype(int)
        model = T.fit(rows, labels, np.ones(size))

        def score(text, model=model, known=known):
            i, n, w = T.counted(text, known)
            held = np.isin(i, model.wanted)
            return model.score(np.searchsorted(model.wanted, i[held]), T.values(n[held], w))

        plain = " ".join(fill[:12])
        assert score(plain + " slur") > 2 * score(plain) and score(plain) < 0.1, (size, score(plain + " slur"), score(plain))


def test_factorization_scores_as_sums_over_pairs():
    import numpy as np

    from vaultql.llm import toxicity as T

    rng = np.random.default_rng(4)
    model = T.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for _ in range(20):
        ids = np.flatnonzero(rng.random(9) < 0.6)
        x = rng.random(len(ids))
        z = 0.3 + sum(model.weights[i] * a for i, a in zip(ids, x)) + sum(model.factors[ids[i]] @ model.factors[ids[j]] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert abs(model.score(ids, x) - 1 / (1 + np.exp(-z))) < 1e-9


def test_long_counts_are_alike_in_fitting_and_scoring(spark):
    docs = spark.createDataFrame([(k, ("bad " * 70_000 if k < 4 else "bad ") + "end") if k % 2 else (k, "good end") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels.unionByName(labels))  # repeated labels count each
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()}
    assert got == {k: k % 2 for k in range(60)}


def test_quality(spark, odd):
    got = queries.quality(spark, SF).join(table(spark, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    model = learn_quality(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.predicted for r in score_quality(odd, model).collect()} <= {0, 1}


def test_pieces(spark, odd):
    model = pieces.load_pieces(spark)
    first = pieces.sample_encode(odd, model, seed=3).collect()
    again = pieces.sample_encode(odd.repartition(5), model, seed=3).collect()
    key = lambda r: (r.doc_id or 0, r.text or "", r.ids_sha256)
    assert sorted(map(key, first)) == sorted(map(key, again)) and all(r.lossless for r in first)
    other = pieces.sample_encode(odd, model, seed=4).collect()
    assert sorted(map(key, first)) != sorted(map(key, other))
    back = pieces.decode(pieces.sample_encode(odd, model), model).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back)


def _segmentations(model, text):
    """Every way to spell a text in pieces, with the product of their weights: by brute force."""
    import numpy as np

    chars = ["▁" if c == " " else "\0mark" if c == "▁" else c for c in " " + text]
    fallback = model.weight[np.isfinite(model.weight)].min() - 5

    def ways(at):
        if at == len(chars):
            yield (), 0.0
        for end in range(at + 1, len(chars) + 1):
            piece = "".join(chars[at:end])
            if piece in model.pieces:
                step = (model.pieces[piece],), model.weight[model.pieces[piece]]
            elif end == at + 1:
                step = tuple(int(model.byte_ids[b]) for b in text[at - 1].encode()), fallback
            else:
                continue
            for rest, weight in ways(end):
                yield step[0] + rest, step[1] + weight

    return {ids: float(np.exp(w)) for ids, w in ways(0)}


def test_pieces_are_drawn_by_their_weights(spark):
    import numpy as np

    model = pieces.load_pieces(spark)
    for text in ("the cat", "né ☃", "aaaa"):
        ways = _segmentations(model, text)
        total = sum(ways.values())
        n = 20_000
        drawn = pieces.Sampler(model).sample([text] * n, list(range(n)), 1)
        seen: dict[tuple, int] = {}
        for ids in drawn:
            seen[tuple(ids.tolist())] = seen.get(tuple(ids.tolist()), 0) + 1
        assert set(seen) <= set(ways)
        for ids, w in ways.items():
            share = w / total
            assert abs(seen.get(ids, 0) / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 1e-4


def test_language_against_plain_sizes(spark):
    import zstandard

    from vaultql.llm import language

    docs = table(spark, "documents").limit(60)
    model = learn_languages(table(spark, "documents"))
    got = {r.doc_id: r for r in identify_language(docs, model).collect()}
    for r in docs.collect():
        plain = language.letters(r.text)
        blocks = [plain[k : k + language.BLOCK].encode() for k in range(0, len(plain), language.BLOCK)]
        sizes = {}
        for name, raw in model.dictionaries.items():
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(pack.compress(b)) for b in blocks)
        best, second = sorted(sizes.values())[:2] if plain else (0, 0)
        assert got[r.doc_id].lang_pred == ("und" if not plain else min(sizes, key=lambda n: (sizes[n], list(sizes).index(n))))
        if plain:
            assert abs(got[r.doc_id].margin - (second - best) / best) < 1e-12 and got[r.doc_id].rejected == ((second - best) / best < 0.003)


def test_language_sample_of_copies_is_bounded(spark):
    fr, de = "le chat et la souris sont dans la maison avec le chien ", "der hund und die katze sind in dem haus mit der maus "
    rows = spark.range(30_000).selectExpr(f"CASE WHEN id % 2 = 0 THEN 'fr' ELSE 'de' END AS lang", f"CASE WHEN id % 2 = 0 THEN '{fr}' ELSE '{de}' END AS text")
    model = learn_languages(rows)
    assert all(len(d) > 30 for d in model.dictionaries.values()) and set(model.dictionaries) == {"fr", "de"}
    assert identify_language(spark.createDataFrame([("die katze und der hund",)], "text string"), model).first().lang_pred == "de"


def test_quality_scores_are_sums_of_table_entries(spark):
    import bisect
    import math

    import zstandard

    from vaultql.llm import quality

    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = learn_quality(docs, labels)
    some = docs.limit(50)
    got = {r.doc_id: (r.score, r.predicted) for r in score_quality(some.selectExpr("*", "'x' AS score"), model).collect()}
    pack = zstandard.ZstdCompressor(level=1).compress
    for r in some.collect():
        x = quality.features(r.text, pack)
        z = model.bias
        for f, t in enumerate(model.tables):
            z += t[bisect.bisect_right(list(model.edges[f]), x[f])]
        for (f, g), t in zip(model.pairs, model.pair_tables):
            z += t[bisect.bisect_right(list(model.pair_edges[f]), x[f]), bisect.bisect_right(list(model.pair_edges[g]), x[g])]
        score = 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == int(score >= 0.7)


def test_warc(spark):
    html = '<html><head><title>T  t</title><script>no()</script></head><body><p>One &amp; <b>two</b></p><a href="/x">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a", html), (2, None, None), (1, "http://a", html)], "page_id long, url string, html string")
    got = warc.derive(warc.responses_from_pages(pages, keep=["page_id"]), keep=["page_id"])
    rows = sorted(warc.serialized(got).collect(), key=lambda r: (r.page_id, r.part))
    assert len(rows) == 6 and bytes(rows[2].block) == b"One & two\nlink" and rows[0].refers_to == rows[2].refers_to != rows[4].refers_to
    assert rows[2].payload_digest == warc.digest(html.encode()) and rows[2].source_headers["content-length"] == str(len(html))
    assert f"conversion-record-id: {rows[2].record_id}".encode() in bytes(rows[0].block) and b"outlink: /x" in bytes(rows[0].block)
    back = list(warc.parsed(b"".join(bytes(r.warc) for r in rows)))
    assert [b for _, b in back] == [bytes(r.block) for r in rows] and back[2][0]["warc-refers-to"] == rows[2].refers_to


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>T</title><p>All the text.</html>", "All the text."),
        ("<head><title>T</title>All <b>the</b> text.", "All the text."),
        ("<head><meta charset=x><style>a {}</style><script>b()</script>\n<h1>One</h1><p>Two", "One\nTwo"),
        ("<title>T</title><p>One<noscript>No<p>more</noscript><p>Two", "One\nTwo"),
        ("<head><noscript><img src=x><p>No script</p></noscript></head><body><p>One", "One"),
        ("<head><title>T</title><noscript><p>One<p>Two", "One\nTwo"),
        ("<p>One<noscript>Two<script>no()</script><p>Three", "OneTwo\nThree"),
        ("<p>One<svg><text>no</text><p>Two<div>Three", "One\nTwo\nThree"),
        ("<p>One<svg><foreignObject><p>no</p></foreignObject></svg>Two", "OneTwo"),
        ("<head><template><p>no</p></template><title>T</title></head><p>One", "One"),
    ],
)
def test_text_without_end_tags(html, text):
    assert warc.html_text(html)[0] == text


def test_warc_files(spark, tmp_path):
    import gzip
    import zlib

    page = "<p>Grüße, wörld</p>"

    def record(body, headers="", kind="response", length=None):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n" + headers.encode() + b"\r\n" + body
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:x>\r\nWARC-Target-URI: http://a\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"

    raw = page.encode("latin-1")
    packed = gzip.compress(raw)
    chunked = b"".join(b"%x;note\r\n%s\r\n" % (len(packed[k : k + 7]), packed[k : k + 7]) for k in range(0, len(packed), 7)) + b"0\r\n\r\n"
    forms = [
        record(raw), record(packed, "Content-Encoding: gzip\r\n"), record(chunked, "Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n"), record(zlib.compress(raw)[2:-4], "Content-Encoding: deflate\r\n"),
        record(raw, "Transfer-Encoding: chunked\r\n"), record(b"gone", length="many"), record(raw, kind="request"), record(packed[:-6], "Content-Encoding: gzip\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(forms) + record(raw)[:-30])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, forms[:3])))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, forms[:2])) + gzip.compress(forms[2])[:-40])
    (tmp_path / "d.warc.gz").write_bytes(b"no gzip")
    got = warc.derive(warc.read_warc(spark, str(tmp_path))).where("part = 1").collect()
    assert len(got) == 6 + 3 + 2 and {bytes(r.block).decode() for r in got} == {"Grüße, wörld"}
    assert {r.payload_digest for r in got} == {warc.digest(raw), warc.digest(packed), warc.digest(zlib.compress(raw)[2:-4]), warc.digest(packed[:-6])}
    odd = warc.derivatives("<urn:x>", None, None, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nxyz")
    assert odd[1][-2] == b"" and b"source-undecoded: br" in odd[0][-2]
    assert warc.unchunked(b"5\r\nhel") == b"hel" and warc.unchunked(b"<p>no sizes") == b"<p>no sizes"


def test_warc_against_plain_records(spark):
    import base64
    import hashlib

    pages = table(spark, "pages").limit(40).collect()
    got = {(r.page_id, r.part): r for r in queries.warc_derivatives(spark, SF).collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for p in pages:
        text = "\n".join(x for x in (" ".join(y.split()) for y in warc.html_text(p.html)[0].split("\n")) if x).encode()
        meta, plain = got[p.page_id, 0], got[p.page_id, 1]
        assert (meta.warc_type, plain.warc_type, plain.content_type) == ("metadata", "conversion", "text/plain; charset=utf-8")
        assert meta.refers_to == plain.refers_to and meta.target_uri == plain.target_uri == p.url and meta.record_id != plain.record_id
        assert plain.payload_digest == meta.payload_digest == sha(p.html.encode()) and plain.block_digest == sha(text) and plain.content_length == len(text)
    assert len({r.record_id for r in got.values()}) == len(got)


def test_rules_in_four_languages(spark):
    clean = "Das ist ein ganzer Satz. Ceci est une phrase. Esta es una frase."
    bad = ["Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "All rights reserved.", "Startseite", "Lire la suite", "iniciar sesión", "a » b » c."]
    got = clean_lines(spark.createDataFrame([(0, "\n".join([clean, *bad]))], "doc_id long, text string")).first()
    assert got.clean_text == clean and got.n_bad_lines == len(bad)


def test_rules_edges(odd):
    got = {r.doc_id: r for r in clean_lines(odd.withColumn("n_words", F.lit("clash"))).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].n_words == 5001 and got[5].n_repeat_words == 5000


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    texts = [rng.choice([" ", "\n", "\t"]).join(rng.choices("abcdefg", k=rng.randint(0, 60))) for _ in range(150)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (got[k].n_words, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines)))


@pytest.mark.parametrize("coding", ["gzip", "zstd"])
def test_every_member_of_a_body_is_decoded_up_to_the_bound(coding):
    import gzip

    import zstandard

    pack = gzip.compress if coding == "gzip" else zstandard.ZstdCompressor().compress
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: {coding}\r\n\r\n".encode()
    made = warc.derivatives("s", "u", "d", head + pack(b"first ") + pack(b"") + pack(b"second"))
    assert made[1][-2] == b"first second" and b"source-truncated" not in made[0][-2]
    assert warc.derivatives("s", "u", "d", head + pack(b"first") + b"\0\0rest")[1][-2] == b"first"
    assert warc.derivatives("s", "u", "d", head + pack(b"first " * 1000)[:-9])[1][-2].startswith(b"first") or coding == "zstd"
    bomb = head + pack(bytes(40 << 20)) + pack(b"more")
    small = warc.derivatives("s", "u", "d", bomb, 3 << 20)
    assert len(bomb) < 1 << 20 and small[1][-2] == bytes(3 << 20) and b"source-truncated: decoded body, after 3145728 bytes" in small[0][-2]
    exact = warc.derivatives("s", "u", "d", head + pack(bytes(3 << 20)), 3 << 20)
    assert len(exact[1][-2]) == 3 << 20 and b"source-truncated" not in exact[0][-2]
    assert b"source-undecoded: " in warc.derivatives("s", "u", "d", head + b"no such stream")[0][-2]


def test_pii(spark):
    a = "Mail Ann.Lee@mail.com or ANN.LEE@MAIL.COM, call +1 (017) 555-7713, ip 10.1.2.3 v1.2.3.4.5, card 4111 1111 1111 1111 or 4111111111111111."
    b = 'token = "' + "0a" * 20 + '" ssn 123-45-6789, Mrs. Mary Smith met Mr Smith and г-жа Анна Иванова; iban DE44 5001 0517 5407 3249 31!'
    rows = [(1, a, "x"), (2, b, "x"), (3, a, "x"), (4, None, "x"), (5, "", "x"), (6, "plain 12 text", "x"), (7, "bob.roe@mail.com", "x")]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string, n_entities string"), key="k").collect()}
    assert got[1].text == got[3].text and got[4].text is None and got[5].text == "" and got[6].text == rows[5][1] and got[6].n_entities == 0
    mails = re.findall(r"[^\s,]+@[^\s,]+", got[1].text)
    assert mails[0] == mails[1].lower() and mails[1].isupper() and mails[0] != "ann.lee@mail.com" and mails[0] != got[7].text
    cards = re.findall(r"card ([\d ]+) or (\d+)", got[1].text)[0]
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", cards[0])
    digits = [int(d) for d in cards[1]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert "v1.2.3.4.5" in got[1].text and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text) and got[1].n_entities == 6 and got[1].n_distinct == 4
    mary, smith, smith2 = re.search(r"Mrs\. (\w+) (\w+) met Mr (\w+) and", got[2].text).groups()
    assert smith == smith2 != "Smith" and mary.endswith("a") and re.search(r"г-жа [А-Я][а-я]+а [А-Я][а-я]+ова;", got[2].text)
    assert re.search(r"iban DE\d\d( [0-9]{4}){4} [0-9]{2}!", got[2].text) and re.search(r'"[0-9a-f]{40}"', got[2].text) and "123-45-6789" not in got[2].text
    assert len(pii.replace_pii(spark.createDataFrame([], SCHEMA), key="k").collect()) == 0


def test_pii_people(spark):
    a = "Dr. Mary Smith wrote. Mrs. Mary Smith signed; Mary Smith left, said Smith. SMITH? Smithers, Mary's: MRS"
    b = "Dr. Mary Smith again, and Mr. Kim Lee with Mrs. Kim Park. Prof. Kim Lee; г-жа Анна Иванова и Prof Анна Иванова. Smith"
    rows = [(1, a, 5), (2, b, 6), (3, "Mary Smith alone", 7)]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string, row int"), key="k").collect()}
    given, family = re.match(r"Dr\. (\w+) (\w+) wrote", got[1].text).groups()
    assert got[1].text == f"Dr. {given} {family} wrote. Mrs. {given} {family} signed; {given} {family} left, said {family}. SMITH? Smithers, {given}'s: MRS"
    assert got[2].text.startswith(f"Dr. {given} {family} again") and got[2].text.endswith(f". {family}") and given.endswith("a")
    him, lee, her, park, him2, lee2, anna, ivanova, anna2, ivanova2 = re.search(r"Mr\. (\w+) (\w+) with Mrs\. (\w+) (\w+)\. Prof\. (\w+) (\w+); г-жа (\w+) (\w+) и Prof (\w+) (\w+)\.", got[2].text).groups()
    assert (him, lee, anna, ivanova) == (him2, lee2, anna2, ivanova2) and him != her and him.endswith("o") and her.endswith("a") and anna.endswith("а")
    assert got[3].text == "Mary Smith alone" and got[3].row == 7 and got[1].n_distinct == 1


def test_pii_names_of_any_form(spark):
    rows = [
        (1, "Mrs. Anna Maria Schmidt and Mr. John Q. Smith; Mrs. Anna Schmidt."), (2, "Dr. Smith came. Dr. Smith’s dog and Dr. Smith's cat."), (3, "Dr. Παπαδόπουλος met Ms. 王 and Prof. Müller-Lüdenscheidt."),
        (4, "Mr. de Vries saw Frau von der Leyen."), (5, "Mr. Will Rose came. Will you go? Rose wine, if they will; a rose. Will Rose went."), (6, "Herr Karl Heinz Otto von Berg"), (7, "Sir Ian Bryan-Jones's hat"),
    ]
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    a, m, s, j, q, s2, a2, s3 = re.fullmatch(r"Mrs\. (\w+) (\w+) (\w+) and Mr\. (\w+) (\w)\. (\w+); Mrs\. (\w+) (\w+)\.", got[1]).groups()
    assert (a, s) == (a2, s3) and len({a, m, s, j, s2} & {"Anna", "Maria", "Schmidt", "John", "Smith"}) == 0 and a.endswith("a") and q.isupper()
    x, y, z = re.fullmatch(r"Dr\. (\w+) came\. Dr\. (\w+)’s dog and Dr\. (\w+)'s cat\.", got[2]).groups()
    assert x == y == z == s2
    greek, han, one, two = re.fullmatch(r"Dr\. (\w+) met Ms\. (\w+) and Prof\. (\w+)-(\w+)\.", got[3]).groups()
    assert re.fullmatch("[Α-Ωα-ωίόύέάήώ]+", greek) and greek != "Παπαδόπουλος" and han != "王" and all("\u4e00" <= c <= "\u9fff" for c in han) and one[0].isupper() and two[0].isupper()
    assert re.fullmatch(r"Mr\. de \w+ saw Frau von der \w+\.", got[4]) and "Vries" not in got[4] and "Leyen" not in got[4]
    will, rose = re.match(r"Mr\. (\w+) (\w+) came", got[5]).groups()
    assert got[5] == f"Mr. {will} {rose} came. Will you go? Rose wine, if they will; a rose. {will} {rose} went."
    assert re.fullmatch(r"Herr \w+ \w+ \w+ von \w+", got[6]) and not set(got[6].split()) & {"Karl", "Heinz", "Otto", "Berg"}
    assert got[7].startswith("Sir ") and got[7].endswith("'s hat") and "Bryan" not in got[7] and "Jones" not in got[7]


def test_pii_against_brute_force(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    digits = lambda n: "".join(rng.choices("123456789", k=n))
    makers = {
        "email": lambda: f"u{digits(3)}.{rng.choice('abc')}@h{digits(1)}.co.uk", "secret": lambda: hexes(rng.choice([32, 40, 128])), "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "ip6": lambda: ":".join(hexes(4) for _ in range(8)), "card": lambda: f"{digits(4)} {digits(6)} {digits(5)}", "phone": lambda: "0171 " + digits(7), "us": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        "token": lambda: "api_key=" + "".join(rng.choices("abcXYZ", k=10)) + digits(10),
    }
    pool = [(k, f()) for k, f in makers.items() for _ in range(12)]
    picks = [[rng.choice(pool) for _ in range(rng.randint(0, 6))] for _ in range(150)]
    texts = ["".join(f"word [{s}] " for _, s in p) + "end" for p in picks]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()}
    seen: dict[str, str] = {}
    for k, p in enumerate(picks):
        new = re.findall(r"\[([^\]]*)\]", got[k].text)
        assert re.sub(r"\[[^\]]*\]", "[]", got[k].text) == re.sub(r"\[[^\]]*\]", "[]", texts[k]) and len(new) == len(p) == got[k].n_entities
        for (_, old), made in zip(p, new):
            assert seen.setdefault(old, made) == made != old  # one surrogate for each, in all documents
            form = lambda x: re.sub(r"\d+", "0", x) if x.count(".") == 3 and "@" not in x else re.sub("[0-9a-f]", "x", x) if ":" in x or len(x) >= 32 else re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x)))
            assert form(old) == form(made)
        assert got[k].n_distinct == len({s for _, s in p})
    assert len(set(seen.values())) == len(seen) > 80 and not set(seen.values()) & set(seen)


def test_pii_of_very_long_runs(spark):
    n = 30_000
    runs = ["x@" + "ab." * n + "com", "a" * 3 * n + "@", "a.b-" * n + "@x.org", "0a" * n, "0a" * n + "z", "DE44" + " 5001" * n, "1234 " * n, "+1 23" + " 23" * n, "1.2.3.4." * n, "Mr " + "Aa " * n, "ab:" * n, "a::" * n, "key=" + "a1-" * n, "token: " * n, "0171 " * n, "Dr " * n]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame([(k, t + " bob@mail.com") for k, t in enumerate(runs)], "doc_id long, text string"), key="k").collect()}
    assert len(got) == len(runs) and not any("bob@mail.com" in r.text for r in got.values())


def test_pii_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("email", f"a@b{k % 10}{k // 10 % 10}.c{'dx'[k % 2]}") for k in range(100)] + [("given_latinf", f"name{k}") for k in range(3000)], "kind string, canonical string")
    got = pii.assigned(entities, "k").collect()
    assert len(got) == 3100 == len({(r.kind, r.surrogate) for r in got}) and not {r.surrogate for r in got} & {r.canonical for r in got}


def test_pipeline_stages(spark):
    """Each stage on its own input, with planted copies, passages, entities and texts without letters."""
    from vaultql.llm.common import alnum_words, blank_words

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    base = queries.table(spark, sf, "documents")
    long = base.where("length(text) > 400 AND lang = 'en'").orderBy("doc_id").limit(3).collect()
    item = queries.table(spark, sf, "benchmark").where("length(text) > 150").orderBy("item_id").first()
    planted = [
        (9001, long[0].text, "en", "x", 1), (9002, long[1].text + " tail", "en", "x", 1), (9003, "12 34 !!", "en", "x", 1), (9004, None, None, None, None), (9005, "", "en", None, 0),
        (9006, item.text, "en", "x", 1), (9007, " ".join(long[2].text.split()[::-1]) + " write to Ann.Lee@mail.com or 10.1.2.3 please", "en", "x", 1),
    ]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema)).cache()
    texts = lambda frame: {r.doc_id: r.text for r in frame.collect()}

    before = texts(docs)
    kept = stages["language ID"](spark, docs, sf).cache()
    assert kept.columns == base.columns
    model = learn_languages(docs)
    want = {r.doc_id for r in identify_language(docs, model).collect() if not r.rejected}
    assert set(texts(kept)) == want and not {9003, 9004, 9005} & want and len(want) > 0.9 * (len(before) - 3)

    before = texts(kept)
    once = stages["MinHash near-dedup"](spark, kept, sf).cache()
    sets = {}
    for k, t in before.items():
        w = blank_words((t or "").encode())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert set(texts(once)) == {k for k in ids if root(k) == k} and 9001 not in texts(once) and long[0].doc_id in texts(once)

    before = texts(once)
    clean = stages["benchmark decontamination"](spark, once, sf).cache()
    windows = set()
    for r in queries.table(spark, sf, "benchmark").collect():
        w = alnum_words(r.text.encode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()

    def dirty(t):
        w, hit = alnum_words((t or "").encode()), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert set(texts(clean)) == {k for k, t in before.items() if not dirty(t)} and 9006 in before and 9006 not in texts(clean)

    before = texts(clean)
    private = stages["PII"](spark, clean, sf).cache()
    after = texts(private)
    assert set(after) == set(before) and "Ann.Lee@mail.com" not in after[9007] and "10.1.2.3" not in after[9007] and after[9007].endswith(" please")
    every = re.compile(pii.PATTERNS["email"].replace("\\p{L}\\p{N}", "\\w").replace("\\p{L}", "\\w"))
    found = {k: every.findall(t) for k, t in before.items()}
    assert all((before[k] == after[k]) or found[k] or re.search("[0-9]|\\b(?:Mr|Mrs|Dr|Herr|Frau|Mme)", before[k]) for k in before)
    assert not any(m in after[k] for k, ms in found.items() for m in ms)
    assert all(r.n_chars == len(r.text) for r in private.collect())

    coded = stages["SentencePiece encoding and decoding"](spark, private, sf)
    model = pieces.load_pieces(spark)
    back = {r.doc_id: r.decoded for r in pieces.decode(coded, model).collect()}
    assert back == after and all(r.lossless and len(r.ids) == r.n_pieces for r in coded.collect())


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) > 100 and all(r.lossless and len(r.ids) == r.n_pieces for r in out)


def test_pipeline_without_rows(spark, tmp_path):
    for name in ("documents", "benchmark"):
        queries.table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
