import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
from fixtures import SCHEMA, edge_rows, personal, secrets, spans_of
from pyspark.sql import functions as F

from cytoquilt.llm import line_dedup, pii, registry
from cytoquilt.llm import secrets as secret_scan
from cytoquilt.llm.spans import Kind, add_spans, written


# ---- line dedup
def brute_lines(rows, ratio, min_pages, min_chars=1, article=500):
    """(host, text) rows in, texts out."""
    pages, seen = collections.Counter(), collections.Counter()
    for host, text in rows:
        pages[host or ""] += 1
        seen.update({(host or "", x.strip(" ")) for x in (text or "").split("\n") if len(x.strip(" ")) >= min_chars})
    out = []
    for host, text in rows:
        if text is None:
            out.append(None)
            continue
        key = host or ""
        gone = {x for x in (y.strip(" ") for y in text.split("\n")) if seen[key, x] >= min_pages and seen[key, x] > pages[key] * ratio}
        left = "\n".join(x for x in text.split("\n") if x.strip(" ") not in gone)
        out.append(left if left.strip() or len(text) < article else text)
    return out


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(5)
    lines = [f"line number {k} with some words" for k in range(30)] + ["short", "", "  ", "  line number 1 with some words "]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6))), rnd.choice(["a", "b", None, ""])) for i in range(300)]
    rows += [(500, None, "a"), rows[3], rows[3]] + [(600 + i, "line number 2 with some words\nline number 3 with some words", "c") for i in range(5)]
    # short site furniture, pages to sign in, and an article that was copied often
    rows += [(700 + i, f"Menu\nown words of page {i}\nSign in", "d") for i in range(50)] + [(800 + i, "Sign in\nForgot?", "d") for i in range(14)]
    rows += [(900 + i, "a long article " * 50 + "\nwith an end", "d") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = line_dedup.drop_boilerplate(df, "doc_id", "source", "text", ratio=0.12, min_pages=3).collect()
    wanted = brute_lines([(r[2], r[1]) for r in rows], 0.12, 3)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(str((r[0], t)) for r, t in zip(rows, wanted))
    assert any(a != r[1] for a, r in zip(wanted, rows))
    texts = {r.doc_id: r.text for r in got}
    assert texts[710] == "own words of page 10" and texts[803] == "" and texts[903] == rows[-1][1]


def test_line_dedup_edges_and_sql(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    out = line_dedup.drop_boilerplate(df, "doc_id", "source", "text")
    wanted = brute_lines([(r[2], r[1]) for r in edge_rows()], 0.01, 3)
    assert out.columns == df.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(str((r[0], t, *r[2:])) for r, t in zip(edge_rows(), wanted))
    assert line_dedup.drop_boilerplate(df.limit(0), "doc_id", "source", "text").count() == 0
    rows = [(i, "frame of the whole site\nown words %d\n\nx" % i if i % 3 else "frame of the whole site", "en", "s%d" % (i % 2), 9) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = sorted(map(str, (tuple(r) for r in line_dedup.drop_boilerplate(docs, "doc_id", "source", "text").collect())))
    table = con.execute(line_dedup.oracle()).fetchall()
    clean = [tuple(None if isinstance(x, float) and math.isnan(x) else int(x) if isinstance(x, float) else x for x in r) for r in table]
    assert got == sorted(map(str, clean)) and any("frame" not in r for r in got)


# ---- spans
def test_spans_of_many_matches(spark):
    text = "é😀" + "".join(f"ab{i % 7} " for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ab")], "id int, text string")
    got = {r.id: r.s for r in add_spans(df, "text", [Kind("w", "ab[0-9]?")], "s").select("id", written(F.col("s")).alias("s")).collect()}
    assert got[1] == ",".join(f"w:{m.start()}:{m.end()}" for m in re.finditer("ab[0-9]?", text)) and got[4] == "w:0:2"
    assert got[2] == got[3] == ""


PARTS = ["token", "Secret", "PASSWORD", "api_key", "apikey", "passwd", "=", ":", " = ", "'", '"', "abcdef012345", "ABCdef+/9", "AKIA", "ABCDEFGHIJKLMN",
         "0123456789abcdef", "deadbeef", " ", "\n", "é", "😀", "x", "ghp_", "Z" * 40, "xoxb-", "1234567890"]
PERSONAL = ["a.b", "@", "mail", ".", "co", ".org", "1", "22", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "+1 ", "(212) ",
            "555-0100", "_", "é", "😀", "\n", "0", "999999", "10.0.0.1"]


def texts(parts, n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)] + [r[1] for r in edge_rows()]


def test_secrets_against_brute_force(spark):
    rows = list(enumerate(texts(PARTS, 1500, 6)))
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").repartition(4)
    got = secret_scan.find_secrets(df, "doc_id", "text", name="found").select("doc_id", *registry.digest(F.col("found"), secret_scan.BASE)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        wanted = secrets(rows[r.doc_id][1] or "")
        assert r.base_sha256 == hashlib.sha256(spans_of(wanted).encode()).hexdigest(), (rows[r.doc_id], r.spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in wanted) for k in secret_scan.BASE)
    assert any("github" in r.spans for r in got)


def satisfied(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(satisfied(q, text) for q in query[1])


def test_trigram_queries_are_necessary():
    queries = {r.name: (re.compile(r.pattern), secret_scan.trigram_query(r.pattern)) for r in secret_scan.RULES}
    assert queries["hex"][1] is True and all(q is not True for k, (_, q) in queries.items() if k != "hex")
    extra = ["eyJabcdefgh01.eyJabcdefgh01.abcdefgh01", "-----BEGIN RSA PRIVATE KEY-----", "https://u:p@h", "AIza" + "x" * 35, "xoxp-12345678901"]
    hits = 0
    for text in [*texts(PARTS, 3000, 7), *extra]:
        for pattern, query in queries.values():
            if text and pattern.search(text):
                hits += 1
                assert satisfied(query, text.lower())
    assert hits > 300


def test_secrets_edges(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    out = secret_scan.find_secrets(df, "doc_id", "text")
    assert out.columns == [*df.columns, "spans"] and out.count() == len(edge_rows())
    assert secret_scan.find_secrets(df.limit(0), "doc_id", "text").count() == 0


# ---- personal data
def test_pii_against_brute_force(spark):
    rows = list(enumerate(texts(PERSONAL, 1500, 8)))
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").repartition(4)
    got = pii.find_pii(df, "doc_id", "text", spans="found").select("doc_id", *registry.digest(F.col("found"), pii.BASE)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        wanted = personal(rows[r.doc_id][1] or "")
        assert r.base_sha256 == hashlib.sha256(spans_of(wanted).encode()).hexdigest(), (rows[r.doc_id], r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in wanted) for k in pii.BASE)


def test_disclosing_terms(spark):
    common = "alpha beta gamma delta".split()
    rows = [(i, f"{common[i % 4]} {common[i // 4 % 4]} words number{i}") for i in range(60)]
    rows += [(100 + i, f"{common[i % 4]} the zanzibar harbour write to agent@spy.example.com {common[i // 4 % 4]} {i}xyz") for i in range(6)]
    rows += [(200, rows[-1][1]), (201, "zanzibar alone"), (202, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in pii.find_pii(df, "doc_id", "text").collect()}
    # by hand: distinct texts, the entity in 6, harbour in 6 of 6, zanzibar in 6 of 7
    n = len({r[1] or "" for r in rows})
    share = {"harbour": 1.0, "zanzibar": math.log2(n * 6 / (7 * 6)) / math.log2(n / 6)}
    assert 0.9 <= share["zanzibar"] < 1
    for i in range(6):
        terms = {t.term: t.removed for t in out[100 + i].terms}
        assert {"harbour", "zanzibar"} <= set(terms) and not set(terms) & set(common)
        assert all(terms[k] for k in share)
        assert [s.kind for s in out[100 + i].spans].count("email") == 1 and {"harbour", "zanzibar"} <= {s.hit for s in out[100 + i].spans}
    assert out[201].terms == [] and out[201].spans == [] and out[202].spans == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df, "doc_id", "text").collect()}
    assert "[EMAIL]" in clean[100] and "zanzibar" not in clean[100] and "harbour" not in clean[100] and "alpha" in clean[100]
    assert clean[201] == "zanzibar alone" and clean[202] is None and clean[0] == rows[0][1]


def test_terms_far_from_the_entity(spark):
    rows = [(i, f"plain words number{i}") for i in range(80)]
    rows += [(100 + i, f"zanzibar {'filler and more ' * 40} agent@spy.example.com {i}xyz {'filler ' * 40} harbour") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in pii.find_pii(df, "doc_id", "text").collect()}
    assert all({"zanzibar", "harbour"} <= {t.term for t in out[100 + i].terms} & {s.hit for s in out[100 + i].spans} for i in range(4))
    clean = {r.doc_id: r.text for r in pii.sanitise(df, "doc_id", "text").collect()}
    assert "zanzibar" not in clean[102] and "harbour" not in clean[102] and clean[5] == rows[5][1]


def test_entities_of_one_and_two_texts(spark):
    rows = [(i, f"plain words {'alpha' if i % 2 else 'beta'}") for i in range(100)] + [(i, f"more words of text {i}") for i in range(100, 200)]
    rows += [(300, "alpha plain quokka writes from once@only.example.com"), (301, "plain wombat calls +1 (212) 555-0100"), (302, "words of wombat and +1 (212) 555-0100")]
    rows += [(303, rows[-3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: {t.term for t in r.terms} for r in pii.find_pii(df, "doc_id", "text").collect()}
    assert "quokka" in out[300] and "wombat" in out[301] & out[302] and out[303] == out[300]
    assert not (out[300] | out[301] | out[302]) & {"words"} and not any(out[i] for i in range(200))


def test_bracketed_terms_go(spark):
    rows = [(i, f"plain words number{i}") for i in range(80)]
    rows += [(100 + i, f"[Falcon] and [Falcon](link) email agent@spy.example.com or [email] {i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in pii.sanitise(df, "doc_id", "text").collect()}
    assert "Falcon" not in clean[100] and "email" not in clean[100] and clean[100].count("[EMAIL]") == 1


def test_sanitise_edges(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    out = pii.sanitise(df, "doc_id", "text")
    assert out.columns == df.columns
    found = {r.doc_id: r.text for r in out.collect()}
    assert found[12] == "[CARD] and [PHONE]" and found[1] is None and found[15].startswith("[EMAIL] [EMAIL][EMAIL]")
    assert found[10].count("[EMAIL]") == 400 and out.count() == len(edge_rows())
    assert pii.sanitise(df.limit(0), "doc_id", "text").count() == 0


def test_luhn_agrees(spark):
    numbers = ["".join(map(str, t)) for t in itertools.product((0, 5, 9), repeat=4)]
    df = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pii.luhn(F.col("n")).alias("ok"))
    assert all(r.ok == (sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(r.n))) % 10 == 0) for r in df.collect())


def test_overlapping_kinds_go_whole(spark):
    rows = [(1, "call +1.2.3.44 555 0100 now"), (2, "é😀 mail me@4.5.6.7.de 4111 1111 1111 1111 end"), (3, "1.2.3.4"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df, "doc_id", "text").collect()}
    for i, t in rows:
        taken = [(a, b, k) for a, _, b, k in personal(t)]
        wanted, at = "", 0
        for a, b, k in taken:
            if a >= at:
                wanted += t[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert clean[i] == wanted + t[at:]
    assert clean[1] == "call [PHONE] now"


def brute_terms(rows, generalise=0.7, remove=0.9, significance=0.05):
    """{text: {term: removed}} by counting all words with all entities over distinct texts."""
    distinct = sorted({t or "" for _, t in rows})
    n = len(distinct)
    words = {t: {w for w in re.split(r"[^\w]|_", t.lower()) if len(w) >= 3} for t in distinct}
    entities = {t: {(k, t[a:b]) for a, _, b, k in personal(t)} for t in distinct}
    nt = collections.Counter(w for t in distinct for w in words[t])
    ne = collections.Counter(e for t in distinct for e in entities[t])
    both = collections.Counter((w, e) for t in distinct for e in entities[t] for w in words[t])
    out = {}
    for t in distinct:
        found = {}
        for e in entities[t]:
            for w in words[t]:
                k, q, p = both[w, e], both[w, e] / ne[e], nt[w] / n
                rest = (ne[e] - k) * (math.log(1 - q) - math.log(1 - p)) if k < ne[e] else 0.0
                if k * (math.log(q) - math.log(p)) + rest < -math.log(significance):
                    continue
                content = math.log2(n / ne[e])
                share = math.log2(n * k / (nt[w] * ne[e])) / content if content > 0 else 0.0
                if share >= generalise:
                    found[w] = max(found.get(w, 0.0), share)
        out[t] = {w: share >= remove for w, share in found.items()}
    return out


def test_terms_and_spans_by_brute_force(spark):
    rnd = random.Random(4)
    common, rare = [f"word{i}" for i in range(30)], [f"rare{i}" for i in range(40)]
    rows = []
    for i in range(260):
        parts = rnd.choices(common, k=rnd.randrange(1, 12))
        if i % 5 == 0:
            parts += rnd.sample(rare, 2) + [f"p{i % 7}@x.org"] + ([f"+1 (212) 555-01{i % 10}0"] if i % 10 else [])
        rnd.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(900, rows[5][1]), (901, None), (902, "ééép0@x.org rare1")]
    wanted = brute_terms(rows)
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text").collect()
    assert any(wanted.values())
    for r in got:
        text = r.text or ""
        terms = wanted[text]
        assert {t.term: t.removed for t in r.terms} == terms
        base = [(a, b) for a, _, b, _ in personal(text)]
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in terms]
        free = [(a, b) for a, b in words if not any(x < b and a < y for x, y in base)]
        assert [(s.start, s.end) for s in r.spans if s.kind == "term"] == free


def test_text_of_very_many_addresses_and_words(spark):
    import time

    text = " ".join(f"name{i} user{i}@list{i}.example.org" for i in range(5000))
    rows = [(0, text)] + [(i, f"plain words number{i}") for i in range(1, 200)]
    started = time.time()
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert clean[0].count("[EMAIL]") == 5000 and "name7 " not in clean[0] and time.time() - started < 120


MORE_RULES = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "google": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "private_key": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----",
    "url_login": r"[a-z]{2,16}://[^\s/:@]{1,128}:[^\s/:@]{1,128}@",
}


def test_added_rules_against_brute_force(spark):
    rnd = random.Random(12)
    parts = ["ghp_", "a1B2" * 9, "xoxb-", "12345-abcde", "AIza", "k_-9" * 9, "eyJ", "abcdEFGH_-", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "https", "://", "user", ":", "pa55", "@", " ", "\n", "é", "z"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 12)))) for i in range(500)]
    rows += [(900, "x ghs_" + "Q" * 40), (901, "eyJabcdefgh.eyJabcdefgh.abcdefghij"), (902, "-----BEGIN EC PRIVATE KEY-----"), (903, "ftp://me:secret@host"), (904, "AIza" + "x" * 35), (905, "xoxp-1234567890")]
    got = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text", name="found").collect()
    assert len(got) == len(rows)
    for r in got:
        found = sorted((s.start, s.end, s.kind) for s in r.found if s.kind in MORE_RULES)
        assert found == sorted((m.start(), m.end(), k) for k, p in MORE_RULES.items() for m in re.finditer(p, r.text))
    assert {s.kind for r in got for s in r.found} >= set(MORE_RULES)
