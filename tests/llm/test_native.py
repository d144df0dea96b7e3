"""Operators 1, 3, 5, 6 and 8 against brute force, and their defined results for odd input."""

import hashlib
import re
from collections import Counter

import pytest

from lumispec.llm import chat, licenses, pii, quality, urls

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "x" * 300_000), (5, "same same same same"), (5, "same same same same"), (None, "no id here"),
    (6, "a@b.c@d.e%x@f.g.h 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567. é 00.00.00.00"),
    (7, "cc by CC-BY all rights reserved All Rights  Reserved gnu General Public License"), (8, "1" * 100_000), (9, "a." * 50_000 + "@" + "b." * 50_000 + "c"),
    (10, "\U0001f600 me@here.org \U0001f600 +49 30 1234567 4242424242424242"), (11, "w1 w2 w3 " * 30),
]


def docs(spark):
    return spark.createDataFrame([(i, t, "odd") for i, t in ODD], "doc_id long, text string, kept string")


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def slow_pii(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {}
    for k, p in pats.items():
        if k == "email" and "@" not in text or k == "ip" and "." not in text:
            out[k] = []
            continue
        got = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")) or k == "card" and 13 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                got.append(m.span())
        out[k] = got
    joined = ",".join(f"{k}:{s}:{e}" for k in pats for s, e in out[k])
    return tuple(len(out[k]) for k in pats) + (joined,)


def held_pii(df, source):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, ",".join(r.base_spans)) for r in df.collect())
    assert got == Counter((i, *slow_pii(t)) for i, t in source)


def test_pii_base(spark):
    held_pii(pii.sanitise(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")), texts(spark))
    quick = [(i, t or "") for i, t in ODD if i not in (8, 9)]  # the plain patterns take too long on the others
    odd = pii.sanitise(docs(spark))
    held_pii(odd.where("doc_id is null or doc_id not in (8, 9)"), quick)
    assert {r.doc_id: r.n_email for r in odd.where("doc_id in (8, 9)").collect()} == {8: 0, 9: 1}
    assert pii.sanitise(docs(spark).limit(0)).count() == 0


def test_pii_terms(spark):
    """A name that only stands near one address discloses it; common words and copies disclose nothing."""
    rows = [(i, f"filler{i} text the zanzibar wrote to ann@x.org on day{i} again") for i in range(6)] + [(100 + i, f"the text of day{i % 7} is filler{i} again and to wrote on") for i in range(200)]
    rows += [(400 + i, "copied onlyhere bob@y.org stays") for i in range(20)] + [(500, "Later Zanzibar came the")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[0][1].index("zanzibar")
    assert f"term:{at}:{at + 8}" in out[0].term_spans
    assert out[500].term_spans == ["term:6:14"] and out[500].sanitised == "Later  came the"
    assert out[400].term_spans == [] and out[400].sanitised == "copied onlyhere [EMAIL] stays"
    assert all(not out[100 + i].term_spans for i in range(200))


def slow_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    rep = len({j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)


def test_quality_base(spark):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, source in ((quality.op8_quality_rules(spark, SF), texts(spark)), (quality.judge(docs(spark)), [(i, t or "") for i, t in ODD])):
        assert rows(df, *cols) == Counter((i, *slow_quality(t)) for i, t in source)
    assert quality.judge(docs(spark).limit(0)).count() == 0


def test_quality_lines(spark):
    body = " ".join(f"word{i}" for i in range(80)) + "."
    junk = " ".join(f"junk{i}$$$" for i in range(80))
    cases = [(1, body), (2, body + "\nHome\nRead more »\nWe use cookies here."), (3, junk), (4, body + "\n" + junk + " " + junk)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert [out[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert out[2].cleaned == body and out[2].n_lines_removed == 3


def slow_license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def at(p):
        return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]

    base = {label: at(p.split()) for label, p in licenses.BASE.items()}
    places = sorted(i for x in base.values() for i in x)
    labels, score = {k for k, v in base.items() if v}, 1.0 if places else 0.0
    for label, t, k, n in licenses.NOTICES:
        t = t.split()
        for i in at(t[k : k + n]):
            share = sum(0 <= i - k + j < len(w) and w[i - k + j] == x for j, x in enumerate(t)) / len(t)
            if share >= 0.5:
                labels.add(label)
                score = max(score, share)
    return len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(k for k, v in base.items() if v)), ",".join(sorted(labels)), round(score, 9)


def test_licenses(spark):
    for df, source in ((licenses.op6_license_scans(spark, SF), texts(spark)), (licenses.scan(docs(spark)), [(i, t or "") for i, t in ODD])):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in df.collect())
        assert got == Counter((i, *slow_license(t)) for i, t in source)
    assert licenses.scan(docs(spark).limit(0)).count() == 0


def slow_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [urls.RULES, [], [("net", "/", "block"), ("a.net", "/x", "allow"), ("b.a.net", "/", "block"), ("a.net", "/x/y", "block"), ("net-a.net", "", "allow")]])
def test_urls(spark, rules):
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://b.a.net/x/y?q", "http://xa.net/x", "x://a.net-/x", "x://net", "x://.net/", "x://a..net/x", "x://net-a.net#/y", "x://c.b.a.net/en/", "http://a.net/x", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd)], "page_id long, url string, rule string").unionByName(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), allowMissingColumns=True)
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert rows(got, "page_id", "url", "host", "path", "rule", "verdict") == Counter((r.page_id, r.url, *slow_url(r.url, rules)) for r in pages.collect())


def test_chat(spark):
    turns = [(1, 1, "b", "hi"), (1, 0, "a", "yo\n"), (1, 2, None, None), (None, 0, "a", "x"), (1, 0, "a", "yo\n"), (1, 200, "b", "late")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn int, role string, text string, start string")
    out = {(r.conv_id, r.speaker): r for r in chat.dialogues(df).collect()}
    assert set(out) == {(1, "a"), (1, "b"), (1, "unknown"), (None, "a")}
    x = out[1, "b"]
    assert x.dialogue == "<|user name=a|>\nyo\n\n" * 2 + "<|assistant|>\nhi\n<|user name=unknown|>\n\n<|assistant|>\nlate\n"
    assert [x.dialogue[int(a) : int(b)] for a, b in (m.split(":") for m in x.masks.split(","))] == ["hi", "late"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_digest(spark):
    r = pii.op1_pii(spark, SF).where("n_email > 0").first()
    assert len(r.base_sha256) == 64 and r.spans.startswith("email:")
    assert hashlib.sha256(b"").hexdigest() == pii.op1_pii(spark, SF).where("n_email + n_ip + n_card + n_phone = 0").first().base_sha256


def test_licence_versions_and_denials(spark):
    rows = [(1, "This file is not under the Apache License, Version 1.1; the MIT License does not apply"), (2, "Licensed under the Apache License, Version 2.0"), (3, "x released under the MIT License."), (4, "This work is licensed under the GNU General Public License version 2"), (5, "it is licensed under CC BY-NC 4.0")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "apache-2.0", 3: "mit", 4: "gpl", 5: "cc-by,cc-by-nc"}


def test_columns_of_any_name_pass_through(spark):
    names = ["_text", "_words", "_row", "_in", "_lines", "_key", "_terms", "_hits", "_email", "_found", "_base", "_good", "a.b"]
    df = spark.createDataFrame([(1, "some text " * 40, *names)], ["doc_id", "text", *names])
    for out in (pii.sanitise(df), quality.judge(df), quality.judge(df, only_kept=True), licenses.scan(df)):
        for r in out.collect():
            assert [r[n] for n in names] == names and r.doc_id == 1


def test_terms_disclose_what_entities_share(spark):
    """A firm's name stands near addresses of one domain, near cards of one issuer, numbers of one network or extension block; no value comes twice."""
    firms = {
        "acmecorp": lambda i: f"p{i}@mail.acme.org",
        "bankhouse": lambda i: next(c for k in range(10) if luhn(c := f"495293000000{i:03d}{k}")),
        "datacentre": lambda i: f"10.20.30.{i}",
        "callshop": lambda i: f"+49 30 555 01{i:02d}",
    }
    rows = [(100 * n + i, f"day{n}x{i} the {name} and {entity(i)} the week{n}x{i}") for n, (name, entity) in enumerate(firms.items()) for i in range(6)]
    rows += [(1000 + i, f"the day{i} and the plain words of week{i}") for i in range(300)] + [(2000, "the acmecorp and others")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        held = [n for n in firms if n in text]
        want = [f"term:{text.index(n)}:{text.index(n) + len(n)}" for n in held]
        assert out[i].term_spans == want, (i, out[i])
    assert out[2000].sanitised == "the  and others"


def test_entities_by_any_separators(spark):
    """One card or phone number, however it is written."""
    df = spark.createDataFrame([("4111 1111-1111 1111", "+49 (30) 123-4567")], "c string, p string")
    span = lambda c: pii.F.struct(pii.F.col(c).alias("v"))
    r = df.select(pii.entities("card", span("c")).alias("c"), pii.entities("phone", span("p")).alias("p")).first()
    assert r.c == ["card:4111111111111111", "card:411111*"] and r.p == ["phone:49301234567", "phone:4930123*"]


def test_terms_of_any_length_disclose(spark):
    """Nothing is cut on the way from an entity to the terms around it."""
    long = "q" * 3000
    rows = [(i, f"day{i} {long} ann@x.org week{i} " + "far " * 3000 + f"{long} end{i}") for i in range(4)] + [(50 + i, f"other words{i} far from saying anything") for i in range(60)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 4").collect()
    for r in out:
        assert long not in r.sanitised and len(r.term_spans) == 2


def test_context_by_brute_force(spark):
    """(entity, term) of each document, counted by hand, on texts with many entities, also next to each other."""
    import random

    rng = random.Random(6)
    parts = ["alpha", "Beta", "g4mma", "é", "12", "ann@x.org", "bob@y.org", "10.0.0.1", ",", "zeta", "eta"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(60)] + ["", None]
    df, _ = pii.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", [])
    got = Counter((r.entity, r.term) for r in pii.contexts(pii.base_spans(df, pii.F.col("_text"))).collect())
    want = Counter()
    for t in texts:
        spans = sorted((m.start(), m.end(), k + ":" + m[0]) for k, p in (("email", r"\w+@[xy]\.org"), ("ip", r"10\.0\.0\.1")) for m in re.finditer(p, t or ""))
        seen = set()
        for j, (s, e, name) in enumerate(spans):
            word = lambda x: [w for w in re.split(r"[^\w]+", x.lower()) if re.search("[^\\W\\d]", w)]
            before = word(t[spans[j - 1][1] if j else 0 : s])[-5:]
            after = word(t[e : spans[j + 1][0] if j + 1 < len(spans) else len(t)])[:5]
            wider = "email:" + name[name.index("@") :] if "@" in name else name[: name.rindex(".") + 1]
            seen |= {(n, w) for n in (name, wider) for w in [None, *before, *after]}
        want.update(seen)
    assert got == want and len(want) > 20


def test_native_plans_have_no_python(spark):
    from lumispec.llm import queries

    for name in ("op1_pii", "op3_chat_formatting", "op6_license_scans", "op8_quality_rules"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|MapInArrow|MapInPandas|ArrowEval", plan), name
