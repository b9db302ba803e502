import os
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import bpe, mixing, mojibake, neardup, pii, residue, site_lines

SITE = "site_id bigint, domain string, page_title string, meta_description string, visible_text_preview string, doc_id string, line_key string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")


def sites(spark, rows):
    """Rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SITE)


def test_residue(spark):
    cases = [
        ("{{ page.title }}", "real text"), ("How {{ mustache }} syntax works", "text"), ("Real", "one\nDear %%FIRST_NAME%%, your lamp waits.\ntwo"), ("Learn JavaScript with a lamp", "A server answers 404 Not Found when a page has moved."),
        ("App", "You need to enable JavaScript to run this app. (ref abcd-efgh)"), ("Lorem ipsum", ""), ("Café Lorem in Town", "soup"), ("Title", "real\nLorem ipsum dolor sit amet."), ("404", None), (None, None), ("", ""), ("a" * 3000, "b\n" * 5000),
    ]
    df = sites(spark, [(i, "h.test", t, None, v) for i, (t, v) in enumerate(cases)] + [(0, "h.test", *cases[0][:1], None, cases[0][1])])
    got = {r.doc_id: r.kind for r in residue.residue(df).collect()}
    assert got == {0: "placeholder", 2: "placeholder", 4: "script", 5: "filler", 7: "filler", 8: "error"}
    assert residue.without_residue(df).select("site_id").distinct().count() == len(cases) - 6
    assert residue.residue(df.limit(0)).count() == 0


def test_hint_holds_for_every_placeholder(spark):
    examples = [
        "{{ name }}", "{% if x %}", "&lt;%= title %&gt;", "${title}", "#{title}", "{$page.title}", "{page.title}", "%%NAME%%", "##NAME##", "%(name)s", "a %s lamp", "[[Title]]", "[sitename]", "[/gallery]", "$TITLE$", "__TITLE__", "PAGE_TITLE_HERE",
        "LAMP_PLACEHOLDER", "XX-TITLE-XX Lamdrua", ":page_title", "@Model.Title", "<your name>", "[FIRST NAME]", "*|FNAME|*", "[object Object]", "Total: NaN", "undefined - Lamps", "TODO: text",
    ]
    rows = [(i, p, x) for i, (p, x) in enumerate(zip(residue.PLACEHOLDER, examples, strict=True))]
    for i, pattern, x in rows:
        line = spark.createDataFrame([(x,)], "x string")
        assert line.select(F.col("x").rlike(residue._anywhere([pattern])), residue.evidence(F.col("x"))).first()[:] == (True, "placeholder"), (i, x)
    got = residue.residue(sites(spark, [(i, "h.test", x, None, "real text") for i, _, x in rows]))
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _, _ in rows]


def test_messages_in_any_wording(spark):
    messages = {
        "error": ["Error establishing a database connection", "Oops! Something went wrong.", "Sorry, this page isn't available.", "Connection timed out", "Pagina non trovata", "This site can't be reached", "Seite wurde nicht gefunden", "The page you are looking for does not exist.", "Attention Required!", "Cette page n’existe plus", "You do not have permission to access this lamp.", "This lamp has been removed (410)."],
        "script": ["JavaScript is required to view this page.", "This page requires JavaScript to be enabled", "Questo sito richiede JavaScript", "JavaScript must be enabled to use this application.", "Lampe needs scripts to show this table", "Bitte JavaScript einschalten, um die Seite anzuzeigen, sie benötigt JavaScript"],
        "filler": ["Your text here", "Insert your own content here", "This is dummy text", "Untitled", "Sample text. Sample text."],
        None: ["The lamp is not available in red", "Add to cart", "We are not open on Sundays.", "Learn JavaScript with a lamp", "Our shop needs JavaScript developers in Bremen", "Find your own home", "Sign in to your account", "Welcome to our site", "Check availability", "You have no items in your basket.", "A server answers 404 Not Found when a lamp has moved", "A café named Lorem serves an ipsum cake", ""],
    }
    rows = [(x, k) for k, listed in messages.items() for x in listed]
    got = spark.createDataFrame(rows, "x string, k string").select("x", "k", residue.evidence(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in got if r.got != r.k] == []


def test_residue_of_long_lines(spark):
    latin = " ".join(residue.LATIN)
    found = {1: latin + ". " + latin, 2: f"{latin}, " * 2000 + "dolor (ref ab-cd)", 3: "Cannot GET /" + "a" * 700, 4: " " * 700 + "Please enable JavaScript.", 5: "bla " * 20_000, 6: "xxx, " * 20_000, 7: "x" * 90_000, 8: "404 -" + " " * 20_000, 9: "Your text goes here. " * 9000}
    clean = {20: f"{latin} " * 2000 + "is what printers set before the words are there", 21: "x" * 90_000 + "y", 22: "404 - " + "a room with a view " * 50, 23: "404 -" + " " * 20_000 + "x" * 99, 24: "test " * 9000 + "is said often", 25: "xxxx xx " * 900}
    rows = [(i, "h.test", "Real", None, "real text\n" + x) for i, x in (found | clean).items()] + [(100 + i, "h.test", x, None, None) for i, x in (found | clean).items()]
    got = {r.doc_id: r.kind for r in residue.residue(sites(spark, rows)).collect()}
    kinds = {i: {3: "error", 4: "script", 8: "error"}.get(i, "filler") for i in found}
    assert got == kinds | {100 + i: k for i, k in kinds.items()}


def test_residue_subtracts_boilerplate(spark):
    notice = "This site requires JavaScript."
    rows = [(i, "h.test", f"t{i}", None, f"text {'abcdefghij'[i]}\n{notice}") for i in range(10)] + [(100 + i, "e.test", "", None, notice) for i in range(6)] + [(200, None, "", None, notice)]
    assert sorted(r.doc_id for r in residue.residue(sites(spark, rows)).collect()) == [100, 101, 102, 103, 104, 105, 200]


def test_recurrent_placeholder_counts(spark):
    footer, notice = "© {{ site.owner }}, all rights reserved", "Please enable JavaScript."
    rows = [(i, "h.test", f"t{i}", None, f"text {'abcdefghij'[i]}\n" + (footer if i < 6 else notice)) for i in range(10)] + [(20, "h.test", "t", None, f"{footer}\n{notice}")]
    rows += [(30 + i, "j.test", "t", None, f"text {'abcdefghij'[i]}\n{notice}") for i in range(10)]
    assert {r.doc_id: r.kind for r in residue.residue(sites(spark, rows)).collect()} == dict.fromkeys([*range(6), 20], "placeholder")


def test_repeated_lines_against_brute_force(spark):
    r = random.Random(2)
    lines = ["Share  THIS page", " share this page 12", "Page 1 of 9", "page 3 of 22", "", "  ", "unique {}"]
    rows = [(i, r.choice(["Hot.test", "hot.test", "b.test", "", None]), None, None, r.choice([None, ""]) if r.random() < 0.1 else "\n".join(r.choice(lines).format(i) for _ in range(4))) for i in range(-20, 150)]
    key = lambda x: re.sub("[0-9]+", "0", re.sub(" +", " ", x.strip(" ").lower()))
    seen = {}
    for i, d, _, _, v in rows:
        for x in (v or "").split("\n"):
            if d and key(x):
                seen.setdefault((d.lower(), key(x)), set()).add(i)
    want = {(i, n) for i, d, _, _, v in rows for n, x in enumerate((v or "").split("\n"), 1) if d and key(x) and len(seen[d.lower(), key(x)]) >= 5}
    df = sites(spark, rows + rows[:30])
    assert Counter((x.doc_id, x.line_no) for x in site_lines.repeated_lines(df).collect()) == Counter(want)
    clean = {x.doc_id: x for x in site_lines.without_repeated_lines(df).collect()}
    assert len(clean) == len(rows)
    for i, d, _, _, v in rows:
        kept = None if v is None else "\n".join(x for n, x in enumerate(v.split("\n"), 1) if (i, n) not in want)
        assert clean[i].clean_text == kept
    assert site_lines.repeated_lines(df.limit(0)).count() == 0


def test_garbled(spark):
    good = ["Das Café öffnet früh", "déjà vu für alle", "Crème brûlée — 12 €", "PROMOÇÃO de MAÇÃ", "¿cerró la señal?"]
    bad = {"Das CafÃ© Ã¶ffnet": "Das Café öffnet", "DÃƒÂ©jÃƒÂ\xa0 vu": "Déjà vu", "cr├¿me": "crème", "caf� nah": "café nah", "12 â‚¬": "12 €", "frÃ¼h": "früh"}
    rows = [(i, "h", t, None, None) for i, t in enumerate(good * 4 + [None, "", "plain", "x" * 20_000 + " é"])] + [(1000 + i, "h", "ok", t, None) for i, t in enumerate(bad)]
    got = {(r.doc_id, r.field): r.restored for r in mojibake.garbled(sites(spark, rows + rows[-2:])).collect()}
    assert got == {(1000 + i, "meta_description"): t for i, t in enumerate(bad.values())}
    assert mojibake.garbled(sites(spark, rows).limit(0)).count() == 0


def test_lattice_and_its_paths():
    edges = mojibake.lattice("Ã©tÃ©x", "cp1252")
    assert edges == [(0, 2, "é"), (3, 5, "é")]
    assert set(mojibake.paths("Ã©tÃ©x", edges)) == {("étéx", 2, 2), ("étÃ©x", 1, 1), ("Ã©téx", 1, 1)}
    assert mojibake.lattice("Ã\ufffd", "cp1252") == [(0, 2, "\ufffd")] and mojibake.lattice("abc", "cp1252") == []
    assert mojibake.paths("abÃ", mojibake.lattice("abÃ", "cp1252")) == []  # a run that the end cuts off, and nothing beside it
    long = "Ã©" * 20_000
    assert mojibake.paths(long, mojibake.lattice(long, "cp1252"))[0] == ("é" * 20_000, 20_000, 20_000)
    assert mojibake._filled("Veld\ufffd", "veld…") == "Veld…" and mojibake._filled("CR\ufffdME", "crème") == "CRÈME"


def test_lost_letters_of_words_of_one_length(spark):
    words = ["слово", "число", "место", "дерево", "молоко"]
    rows = [(i, "h", w, None, None) for i, w in enumerate(words * 3)] + [(100, "h", "сл\ufffdво", None, None), (101, "h", "м\ufffd\ufffdто", None, None), (102, "h", "мо\ufffd\ufffd\ufffdо", None, None)]
    got = {r.doc_id: r.restored for r in mojibake.garbled(sites(spark, rows)).collect()}
    assert got == {100: "слово", 101: "место", 102: "молоко"}


def test_similar_pairs_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randrange(28, 60))] for _ in range(25)]
    rows = []
    for i in range(150):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, "h", r.choice([None, "", "Title A"]), None, " ".join(text)))
    rows += [(500, "h", None, None, None), (501, "h", "x", "y", "")]
    sets = {}
    for i, _, t, m, v in rows:
        if len((v or "").split()) >= 30:
            w = re.findall(r"[^\W_]+", "\n".join([t or "", m or "", v or ""]).lower())
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    df = sites(spark, rows + rows[:20])
    assert Counter((x.id_a, x.id_b) for x in neardup.similar_pairs(df).collect()) == Counter(want)
    long, neardup.LONG_RUN = neardup.LONG_RUN, 3
    try:
        found = neardup.Similar(df, "site_id", ("page_title", "meta_description", "visible_text_preview"), 3, 0.5, 30)
        assert {(x.id_a, x.id_b) for x in found.expanded().collect()} == want
    finally:
        neardup.LONG_RUN = long
    groups = neardup.similar_groups(df, size=3, threshold=0.5, min_words=30).collect()
    assert sorted(g.doc_id for g in groups) == sorted(i for i, *_ in rows)
    root = {i: i for i, *_ in rows}
    texts = {}
    for i, *rest in rows:
        texts.setdefault(tuple(x or "" for x in rest), []).append(i)
    for a, b in list(want) + [(x[0], y) for x in texts.values() for y in x[1:]]:
        ra, rb = root[a], root[b]
        root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    assert {g.doc_id: g.group_id for g in groups} == root
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_similar_pairs_send_no_keys_through_the_driver(spark):
    r = random.Random(5)
    texts = [[f"w{r.randrange(40)}" for _ in range(40)] for _ in range(12)]
    rows = [(i, "h", None, None, " ".join(texts[i % 12][:35] + [f"end{i}"])) for i in range(36)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = neardup.Similar(sites(spark, rows), "site_id", ("visible_text_preview",), 3, 0.5, 30).pairs()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 36
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _candidates(rows):
    """What comes of ``(shingle, size, class, place)``: the weight of each pair, and the marked classes of each long run."""
    x, k, place = zip(*sorted((h << neardup.SIZE_BITS | n, k, p) for h, n, k, p in rows), strict=True)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 4], pa.int64()), pa.array(k[i : i + 4], pa.int64()), pa.array(place[i : i + 4], pa.int32())], names=["x", "k", "place"]) for i in range(0, len(x), 4)]
    weights, marked = Counter(), {}
    for batch in neardup._pairs(Fraction("0.5"))(iter(batches)):
        for row in batch.to_pylist():
            if row["x"] is None:
                weights[row["k_s"], row["k_l"]] += row["weight"]
            else:
                marked.setdefault(row["x"] >> neardup.SIZE_BITS, set()).add(row["k_s"])
    return weights, marked


def test_pairs_of_few_common_shingles_are_no_candidates():
    # 1 and 2 share one shingle of 60, 3 and 4 three, 5 and 6 have two shingles each and share them.
    rows = [(1, 60, 1, 0), (1, 60, 2, 0), *((h, 60, k, h - 2) for h in (2, 3, 4) for k in (3, 4)), *((h, 2, k, h - 5) for h in (5, 6) for k in (5, 6))]
    weights, _ = _candidates(rows)
    assert weights[1, 2] < neardup.COMMON <= min(weights[3, 4], weights[5, 6])


def test_copies_do_not_shorten_a_long_run(monkeypatch):
    monkeypatch.setattr(neardup, "LONG_RUN", 3)
    rows = [(1, 60, k, 0) for k in (1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8)]
    weights, marked = _candidates(rows)
    assert marked == {1: set(range(1, 9))} and not weights


@needs_vocabulary
def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    r = random.Random(5)
    texts = [None, "", " ", "\n\n  x", "<|endoftext|> a", "aaaa" * 500, "naïve café 12345 don't", "漢字かな 🙂👍🏽", "\x00\x1b​", "tab\t\r\n end "] + ["".join(r.choice("ab é漢1 .\n'") for _ in range(80)) for _ in range(60)] + ["z" * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {x.doc_id: x.ids for x in bpe.encoded(df).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert bpe.encoded(df.limit(0)).count() == 0


def test_mixture(spark):
    r = random.Random(6)
    docs = [(i, s, r.randrange(1, 40)) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["tiny"] * 12 + [None] * 5 + ["other"] * 9)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("gone", 0.1, 9), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    sized = spark.createDataFrame([d for d in docs if d[1]], "doc_id bigint, source string, n_tokens bigint")
    old, mixing.DOCS_PER_BUCKET = mixing.DOCS_PER_BUCKET, 50
    try:
        m = mixing.Mixture(sized, targets)
        out = m.sequence().collect()
        shares = {x.source: x for x in m.shares().collect()}
    finally:
        mixing.DOCS_PER_BUCKET = old
    total = sum(x.n_tokens for x in out)
    assert total <= m.budget + 1e-6 and max(Counter((x.source, x.doc_id) for x in out).values()) <= 3
    for s, w in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert abs(shares[s].share - w) < 0.06 and shares[s].repeats <= {"big": 1, "mid": 2, "tiny": 3}[s] + 1e-9
    assert shares["other"].tokens == 0 and shares["gone"].tokens == 0
    finish = [x.finish for x in out]
    assert finish == sorted(finish)
    # A budget beyond the caps of some: the others fill it.
    large = mixing.Mixture(sized, targets, budget=int(sum(n for _, s, n in docs if s in ("big", "mid")) * 1.1))
    given = {x.source: x for x in large.shares().collect()}
    assert sum(x.tokens for x in given.values()) > 0.98 * large.budget and given["big"].repeats > 0.8 and given["tiny"].repeats == pytest.approx(3)
    assert mixing._virtual_end(10, [(0.5, 2.0), (0.5, 100.0)]) == 16 and mixing._virtual_end(10, [(0.5, 2.0)]) == 4 and mixing._virtual_end(10, []) == 0
    empty = mixing.Mixture(sized.limit(0), targets)
    assert empty.sequence().count() == 0 and empty.shares().count() >= 1


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_numbers_and_addresses_of_made_up_texts(model):
    from webloom.llm.pii_training import labelled_texts

    made = list(labelled_texts(2000, 12345))
    tp, fp, fn = Counter(), Counter(), Counter()
    for spans, (_, truth) in zip(model.found([t for t, _ in made]), made, strict=True):
        got, want = {(s.kind, s.start) for s in spans}, {(kind, start) for kind, start, _ in truth}
        for c, found in ((tp, got & want), (fp, got - want), (fn, want - got)):
            c.update(kind for kind, _ in found)
    for kind in pii.KINDS[:4]:
        assert tp[kind] / (tp[kind] + fp[kind]) > 0.93 and tp[kind] / (tp[kind] + fn[kind]) > 0.9, kind
    assert tp["name"] / (tp["name"] + fn["name"]) > 0.9


def test_names_that_training_never_saw(model):
    people = "Siobhan Gallagher|Jürgen Schröder|Angela Merkel|Xi Liu|Noor Khan|Tomasz Nowak|Priya Natarajan|Amélie Dupont-Moretti|Kwame Mensah|Ngozi Okafor|Haruto Tanaka|Lars Björklund|Inês Carvalho|Søren Kjær|Agnieszka Wójcik|Mehmet Yılmaz|Oluwaseun Bello|Ewa Zając|Pádraig Ó Briain|Jean-Luc Fournier".split("|")
    frames = ["Review by {}: the lamp is loud.", "I met {} at the station and we talked.", "Our doctor, {}, lives near the harbour.", "The lamp was bought by {} last week.", "{} visited the museum in Paris.", "{}", "They spoke with {} about the harbour.", "Dear {},\nthanks for the lamp."]
    others = ["The harbour lamp is sold in Paris and London.", "Most visitors from Hamburg buy the lamp in May.", "Diese Lampe aus Hamburg ist neu.", "Die Werkstatt in Bremen öffnet früh.", "Cette lampe de Lyon est belle.", "Please read the Terms of Use.", "Tax ID and VAT ID are on the form.", "In May the museum in Kraków was closed."] * 10
    texts = [f.format(p) for p in people for f in frames]
    found = model.found(texts + others)
    right = sum((s.kind, t[s.start : s.end]) == ("name", p) for (p, t), spans in zip(((p, f.format(p)) for p in people for f in frames), found, strict=False) for s in spans)
    assert right / len(texts) >= 0.9
    assert right / sum(len(spans) for spans in found) >= 0.9
    assert [(s.kind, s.start) for s in model.found(["mail bob@corp.com"])[0]] == [("email", 5)]


def test_word_case_is_the_corpus(spark):
    texts = ["Die Lampe und die Tür", "die Lampe", "Mail jonas@x.example, Jonas", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole, shared = pii.WordCase.of(t for t in texts if t), pii.WordCase(pii.word_case(df).value)
    assert all(whole[w] == shared[w] for w in ("Die", "Lampe", "Jonas", "und", "Nothing"))
    assert shared["Die"] > 8 and shared["Lampe"] == shared["Jonas"] == shared["Nothing"] == 0 and shared["und"] == 15
    assert pii.WordCase(pii.word_case(df.limit(0)).value)["Die"] == 0


def test_personal_information(spark, model):
    text = "Ansprechpartner: Greta Wexgrove, Telefon 415-555-0158\nMail: a.b (at) mail.example\nTax ID 580512-0230 belongs to Mateo K. Order 4471-2209-15 left. See icon@2x.png."
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "no one " * 5000, "x"), (1, text, "x")], "doc_id bigint, text string, kind string")
    found = Counter((r.doc_id, r.kind, r.value) for r in pii.personal_spans(df, model=model).collect())
    assert found == {(1, "name", "Greta Wexgrove"): 2, (1, "phone", "415-555-0158"): 2, (1, "email", "a.b (at) mail.example"): 2, (1, "id_number", "580512-0230"): 2, (1, "name", "Mateo K."): 2}
    clean = {r.doc_id: (r.clean_text, r.n_found) for r in pii.redacted(df, model=model).collect()}
    assert clean[1][0].startswith("Ansprechpartner: [NAME], Telefon [PHONE]\nMail: [EMAIL]\nTax ID [ID_NUMBER] belongs to [NAME]") and clean[2] == (None, 0) and clean[3] == ("", 0) and clean[4][1] == 0
    assert pii.personal_spans(df.limit(0), model=model).count() == 0


def test_merge_rounds_keep_word_borders():
    if not os.path.exists(bpe.DEFAULT_VOCABULARY):
        pytest.skip("no vocabulary")
    m = bpe.merges(bpe.DEFAULT_VOCABULARY)
    assert m.encode([b"", b"a", b"ab", b""])[0] == [] and len(m.encode([b"a"])[0]) == 1
    assert np.array_equal(m.encode([b"the", b"the"])[0], m.encode([b"the"])[0])
    assert m.encode([]) == []
