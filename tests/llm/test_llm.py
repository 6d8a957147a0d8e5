import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlnet.llm import boilerplate, copies, encodings, leakage, personal, queries, tokens

# --- 1: copies ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"b": 1, "a": [2, {"y": "Q r", "x": null}]}', ' {"A":[2,{"X":null,"Y":"q-R"}],"B":1}', True),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False), ("x=1&y=a+b", "y=a%20b&X=1", True), ("salt & pepper", "pepper & salt", False), ("", None, True),
        ("{broken", "broken", True), ("[1.0]", "[10]", False), ("%zz", "zz", True), ("cafe\u0301 x", "CAFE\u0301_x", True), ("a\u0301b", "a b", False),
    ],
)
def test_payload_words(a, b, same):
    assert (copies.payload_words(a) == copies.payload_words(b)) is same


def test_canonical_urls(spark):
    pairs = [
        ("https://e.test/A-b?y=2&x=1#f", " HTTPS://E.TEST/a/b?X=1&&y=2#F\n", True), ("https://e.test/caf%C3%A9", "https://e.test/CAF%c3%89", True), ("http://e.test/", "https://e.test/", False),
        ("https://e.test/?a=x+y", "https://e.test/?a=x%20y", True), ("https://e.test/a/b", "https://e.test/b/a", False), ("https://e.test/%zz", "https://e.test/zz", True), (None, "", True), ("https://e.test/?q=1%26b", "https://e.test/?q=1&b", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    key = lambda c: copies.key_of(copies.url_words(F.col(c)))
    for r in df.select("a", "b", "same", (key("a") == key("b")).alias("got")).collect():
        assert r.got == r.same, r


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_copies_against_brute_force(spark, partitions):
    r = random.Random(partitions)
    rows = [(s, i, "hot" if r.random() < 0.4 else f"k{r.randrange(80)}") for s in ("a", "b") for i in range(300)] + [("a", None, "hot"), ("a", 7, "hot2")]
    df = spark.createDataFrame(rows, "src string, id bigint, key string").withColumn("extra", F.lit(1))
    groups = {}
    for s, i, k in rows:
        if i is not None:
            groups.setdefault((s, k), []).append(i)
    want = sorted((s, min(v), i) for (s, k), v in groups.items() for i in v if i != min(v))
    assert sorted(map(tuple, copies.copies(df, partitions).collect())) == want
    assert sorted(map(tuple, copies.representatives(df, partitions).collect())) == sorted((s, min(v), len(v)) for (s, _), v in groups.items())


def test_copies_of_nothing(spark):
    df = spark.createDataFrame([], "src string, id bigint, key string")
    assert copies.copies(df).count() == 0 and copies.representatives(df).count() == 0


# --- 2: encodings ------------------------------------------------------------------------------------------------------

CZECH = "Příliš žluťoučký kůň úpěl ďábelské ódy a městský archiv třídí říční přechody."
GREEK = "Ο μετεωρολογικός σταθμός ελέγχει τις παλιές φωτογραφίες με ελάχιστη μνήμη."


@pytest.fixture(scope="module")
def mixed(spark):
    bad = {1: CZECH.encode("cp1250").decode("latin-1"), 2: GREEK.encode().decode("latin-1"), 3: GREEK.encode("cp1253").decode("latin-1"), 4: CZECH.encode().decode("cp1250", "replace"), 5: "ok\n" + CZECH.encode("cp1250").decode("latin-1")}
    bad[6] = "".join(c if c < "\x7f" else f"&#{ord(c)};" for c in bad[2])
    bad[7] = "Zimn� dob�"
    rows = [(i, t.encode()) for i, t in bad.items()] + [(100 + i, (CZECH if i % 2 else GREEK).encode()) for i in range(60)] + [(200, b""), (201, None), (202, b"plain ASCII"), (203, b"\xff\xfe")]
    rows = [("r", i, i, bytearray(b) if b is not None else None) for i, b in rows]
    return spark.createDataFrame(rows, "src string, rec_id bigint, source bigint, body binary"), bad


def test_damaged(spark, mixed):
    df, bad = mixed
    model = encodings.learn(df)
    assert {r.rec_id for r in encodings.damaged(df, model).collect()} == {*bad, 203}
    text = {r.rec_id: r.text for r in encodings.restored(df, model).collect()}
    assert text[1] == CZECH and text[2] == GREEK and text[3] == GREEK and text[5] == f"ok\n{CZECH}" and text[6] == GREEK
    assert encodings.damaged(df.limit(0)).count() == 0


PROSE = """Městský archiv sbírá staré mapy a fotografie přístavu. Naše knihovna měří výšku říční hladiny každý den před příchodem návštěvníků.
Zahradník třídí žluté růže a pečlivě přepisuje všechny štítky. Převozník vysvětluje dětem, proč je řeka v zimě tichá. Stará pekárna nabízí čerstvý chléb
a sladké koláče. Učitelka zítra přinese dvě ručně kreslené mapy, které našla ve skříni. Meteorologická stanice hlásí déšť, vítr a občasné přeháňky. Úředník
zapíše číslo žádosti a vrátí průkaz. Průvodce ukáže nejstarší dům ve městě, kde kdysi žil známý hodinář. Šachový kroužek se schází každé úterý večer v klubovně."""


@pytest.mark.parametrize(("written", "read"), [("cp1250", None), ("cp1250", "cp852"), ("cp1250", "iso8859-5"), ("iso8859-2", "cp1257"), ("iso8859-2", "cp1254"), ("cp1250", "iso8859-4")])
def test_ciphers_of_no_list(spark, written, read):
    """One source under a random permutation of the upper half, or a swap that no list has, is found and restored."""
    r = random.Random(4)
    sentences = PROSE.replace("\n", " ").split(". ")

    def page(n):
        return "\n".join(r.sample(sentences, n))

    codes = list(range(128, 256))
    r.shuffle(codes)
    swap = bytes([*range(128), *codes])
    true = {i: page(5) for i in range(100, 140)}
    bad = {i: t.encode(written).translate(swap).decode("latin-1") if read is None else t.encode(written).decode(read, "replace") for i, t in true.items()}
    rows = [("r", i, i % 12, bytearray(page(4).encode())) for i in range(60)] + [("r", i, 99, bytearray(t.encode())) for i, t in bad.items()]
    df = spark.createDataFrame(rows, "src string, rec_id bigint, source bigint, body binary")
    learned = encodings.learn(df)
    text = {x.rec_id: x.text for x in encodings.restored(df, learned).collect()}
    assert len(set(text) & set(true)) >= 0.9 * len(true) and not set(text) - set(true)
    pairs = [(a, b) for i in text for a, b in zip(true[i], text[i]) if a > "\x7f" and a != "\ufffd"]
    assert sum(a == b for a, b in pairs) >= (0.9 if read is None else 0.85) * len(pairs)


def test_ciphers_of_other_scripts():
    """Greek under a permutation: the letters' neighbours are letters under it themselves."""
    greek = (
        "ο μετεωρολογικός σταθμός ελέγχει τις παλιές φωτογραφίες με ελάχιστη μνήμη και η βιβλιοθήκη της πόλης μετρά τη στάθμη του ποταμού κάθε πρωί πριν έρθουν οι επισκέπτες "
        "ο κηπουρός ταξινομεί τους σπόρους και ο φούρναρης γράφει τον κατάλογο του αρχείου με το χέρι ενώ ο οδηγός εξηγεί στα παιδιά γιατί το λιμάνι είναι ήσυχο τον χειμώνα "
        "η δασκάλα φέρνει δύο χάρτες που βρήκε στο παλιό ντουλάπι και ο υπάλληλος σημειώνει τον αριθμό της αίτησης"
    )
    counts, r = {}, random.Random(2)
    for w in greek.split():
        for t in encodings.neighbourhoods(w):
            counts[t] = counts.get(t, 0) + 1
    codes = list(range(0xA1, 0x100))
    r.shuffle(codes)
    own = dict(zip(sorted({c for c in greek if c != " "}), map(chr, codes)))
    pairs = {}
    for w in greek.split():
        for uv in encodings._pairs("".join(own[c] for c in w)):
            pairs[uv] = pairs.get(uv, 0) + 5
    table = encodings.break_cipher(pairs, counts)
    letters = [c for c in greek if c != " "]
    assert sum(table.get(own[c], "").lower() == c for c in letters) >= 0.8 * len(letters)


def test_one_hot_source_is_no_language(spark):
    """All pages of a source with a third of the rows suffer one swap of the list."""
    rows = [("r", i, i % 12, bytearray(PROSE.encode())) for i in range(60)] + [("r", i, 99, bytearray(PROSE.encode("cp1250").decode("latin-1").encode())) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "src string, rec_id bigint, source bigint, body binary")
    got = {x.rec_id: x.text for x in encodings.restored(df).collect()}
    assert set(got) == set(range(100, 130)) and all(t == PROSE for t in got.values())


# --- 4: boilerplate ----------------------------------------------------------------------------------------------------


def _page(article, marked):
    nav, foot = ["Home", "Shop", "Basket"], ["© 2020 Site", "All rights reserved. Prices include tax."]
    if marked:
        return "\n".join(["<nav>", *[f"<a href=/>{x}</a>" for x in nav], "</nav>", "<article>", *[f"<p>{x}</p>" for x in article], '<div class="promo">Read also: Cut te</div>', "</article>", "<footer>", *foot, "</footer>"])
    return "\n".join([*nav, "", *article, "Read also: Another te", *foot])


def test_main_content(spark):
    article = ["Notes on maps: Orkel", "The editor sorts the maps. The team reads the samples once a week, slowly and carefully.", "Orkel 12", "A baker visits the ferry. The guide collects every glossary after a long pause."]
    rows = [(i, 200, "text/html", _page([a.replace("maps", f"maps{i}") for a in article], True)) for i in range(5)]
    rows += [(10, 200, "text/plain", _page(article, False)), (11, 404, "text/html", _page(article, True)), (12, 200, "application/json", "{}"), (13, 200, "text/plain", ""), (14, 200, "text/plain", "Home\nShop"), (15, 200, "text/html", None)]
    df = spark.createDataFrame([(i, s, m, None if b is None else bytearray(b.encode())) for i, s, m, b in rows], "response_id bigint, status int, mime string, body binary")
    got = {}
    for r in boilerplate.main_content(df).collect():
        got.setdefault(r.response_id, []).append(r.line_no)
    assert sorted(got) == [0, 1, 2, 3, 4, 10]
    assert sorted(got[0]) == [7, 8, 9, 10] and sorted(got[10]) == [5, 6, 7, 8]


@pytest.mark.parametrize(
    "true",
    ["The ferry crosses the Øresund (607 km).", "The budget of €40 allows it.", "Der Fährmann zählt " + "die Körbe und " * 20 + "geht.", "Паромщик считает " + "корзины и " * 30 + "уходит."],
)
def test_mended_numbers_and_long_lines(true):
    assert boilerplate.mended(true.encode().decode("latin-1"), {boilerplate._hash(true)}, set()) == true


@pytest.mark.parametrize(
    ("true", "written", "read"),
    [
        ("Alle Preise verstehen sich einschließlich Mehrwertsteuer.", "cp1252", "mac_roman"), ("© 2022 The ferry company", "cp1251", "koi8-r"),
        ("Der Preis, einschließlich Fährgeld", "utf-8", "mac_roman"), ("© 2022 The ferry company", "koi8-r", "cp1251"),
    ],
)
def test_mended_in_any_charset(true, written, read):
    assert boilerplate.mended(true.encode(written).decode(read), {boilerplate._hash(true)}, set()) == true


@pytest.mark.parametrize(("begin", "end"), [("<ARTICLE>", "</ARTICLE>"), ("<Main>", "</Main>"), ("<div Role = 'main'>", "</div>"), ('<div role="article">', "</div>")])
def test_lexicon_of_any_marks(spark, begin, end):
    body = "\n".join([begin, "<p>The editor sorts the maps.</p>", end, "<FOOTER>", "Opening hours of the ferry", "</FOOTER>"])
    df = spark.createDataFrame([(i, 200, "text/html", bytearray(body.encode())) for i in range(3)], "response_id bigint, status int, mime string, body binary")
    around, content = boilerplate.learn_lexicon(df)
    long = "\n".join(["<main>", "<p>x</p>", "</main>", "<footer>", "Imprint " * 100, "</footer>"])
    rows = [(i, 200, "text/html", bytearray(long.encode())) for i in range(3)]
    assert boilerplate._hash(" ".join(["Imprint"] * 100)) in boilerplate.learn_lexicon(spark.createDataFrame(rows, df.schema))[0]
    assert boilerplate._hash("Opening hours of the ferry") in around and boilerplate._hash("The editor sorts the maps.") in content


# --- 7: tokens ---------------------------------------------------------------------------------------------------------


def test_tokens_equal_the_libraries(spark):
    import tiktoken

    ranks = tokens.read_ranks()
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = [None, "", " ", "\n\n  a  \t", "don't I'll we've they'RE", "🚀🚀 naïve 한국어 文章 ١٢٣", "a" * 3000, "<|endoftext|> x", "x" + "​" * 5] + ["".join(r.choice("abc déΩ東 \n1.'") for _ in range(r.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for most in (0, 3, 1000):
        got = {x.doc_id: x.ids for x in tokens.encode(df, most=most).collect()}
        assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).count() == 0


def test_runs_border_where_the_pattern_cuts():
    import regex

    cut = regex.compile(tokens.PATTERN).findall
    r = random.Random(5)
    for k in range(3000):
        t = "".join(r.choice("ab1.'s é\n\t \0\x1c\x85\u2003\u200b ,") for _ in range(r.randrange(1, 14)))
        assert [w for run in tokens.runs(t) for w in cut(run)] == cut(t), repr(t)
        assert "".join(tokens.runs(t)) == t


def test_lexicon_is_minimal_and_exact():
    words = [b"tap", b"taps", b"top", b"tops", b"", b"\xff\x00"]
    lex = tokens.Lexicon(tokens.compile_lexicon((w, [i, i + 1]) for i, w in enumerate(words)))
    assert [lex.get(w) for w in words] == [[i, i + 1] for i in range(len(words))]
    assert all(lex.get(w) is None for w in (b"t", b"tapsx", b"x", b"\xff"))
    assert len(lex.finals) == 6  # the start, after t, after ta and to, after p, the end, and after the odd byte
    ranks = tokens.read_ranks()
    r = random.Random(2)
    for _ in range(300):
        w = bytes(r.choice(b"theandio \xc3\xa9") for _ in range(r.randrange(1, 120)))
        if w not in ranks:
            short = w[:40]
            assert short in ranks or tokens._merge_long(short, ranks) == tokens.merge(short, ranks)


# --- 8: leakage --------------------------------------------------------------------------------------------------------

ITEM = "Read the passage. The dispatcher of Melvorpel counted 525 brittle sundial entries because the beekeeper of Melvorpel concealed 755 woven viaduct entries"
OTHER = "Read the passage. The registrar of Corwil weighed 12 hollow kiln entries whereas nobody in Corwil noticed that 9 of the amber pages softened the loom of Corwil"


def test_leaks(spark):
    words = ITEM.split()
    cases = {
        1: (" ".join(words[3:20]), True), 2: (" ".join(words[3:17]), False), 3: ("x " + " ".join(words[3:22]).upper().replace(" ", " <b>​</b> ") + " y", True),
        4: (" ".join(w if i != 8 else "zzz" for i, w in enumerate(words[3:21])), True), 5: (" ".join(w if i % 5 else "zzz" for i, w in enumerate(words[3:25])), False),
        6: (ITEM.removeprefix("Read the passage. ").replace("Melvorpel", "Zantor").replace("525", "3").replace("755", "4"), False), 7: (None, False), 8: ("", False), 9: ("Read the passage.", False),
    }
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in cases.items()], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "")], "item_id bigint, text string")
    assert sorted(map(tuple, leakage.leaks(docs, bench).collect())) == [(i, 1) for i, (_, leaked) in cases.items() if leaked]
    assert (6, 1) in set(map(tuple, leakage.reparameterised(docs, bench).collect()))
    assert leakage.leaks(docs, bench.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), bench).count() == 0


def test_leaks_through_markup_and_references(spark):
    part = ITEM.split()[3:20]
    long_tag = f'<span data-x="{"y " * 400}">'
    letters = " ".join("".join(f"&#{ord(c)};" if c in "aeiou" else c for c in w) for w in part)
    docs = spark.createDataFrame([(1, " ".join([*part[:8], long_tag, *part[8:]])), (2, letters), (3, "&nbsp;".join(part)), (4, "a < b " + " ".join(part))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id bigint, text string")
    assert sorted(map(tuple, leakage.leaks(docs, bench).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def _both(texts, items, names=True):
    block = leakage.Items(items)
    if not names:
        block.kinds = np.arange(len(block.kinds))
    t = leakage.Texts(block, [leakage.words(x) for x in texts])
    return leakage._leaks(block, t), leakage._consistent(block, t)


def test_slots_decide():
    """Two slots of sixteen words filled otherwise: few enough to be altered words, but another's passage."""
    items = [(1, "It is so. Nobody in Zelvor noticed that 63 of the moonlit pages delayed the archive of the old harbour"), (2, "Why did Pelral go? The clerk of Pelral kept it")]
    other = "nobody in pelral noticed that 69 of the moonlit pages delayed the archive of the old"
    texts = [other, other.replace("pelral", "zelvor"), other.replace("pelral", "zelvr").replace("69", "63"), f"{other.replace('pelral', 'unheard')}, said unheard"]
    leaks, again = _both(texts, items)
    assert leaks == {(1, 0), (2, 0)} and again == {(0, 0), (3, 0)}
    assert _both(texts, items, names=False)[0] == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_reparameterised_numbers_units_and_inconsistent_names():
    items = [(1, "Start here. The clerk of Melvor sold 525 crates within 3 days because the baker of Melvor wanted 755 crates within two weeks")]
    text = "the clerk of {} sold {} crates within {} {} because the baker of {} wanted {} crates within {} {}"
    cases = [
        (("melvor", "17", "9", "hours", "melvor", "18", "four", "weeks"), False, True),  # only numbers and units changed
        (("melvor", "525", "3", "hours", "melvor", "755", "two", "months"), True, False),  # one word in eight altered
        (("zan", "525", "3", "days", "zan", "755", "two", "weeks"), False, True),
        (("zan", "1", "3", "days", "quor", "755", "two", "weeks"), True, False),  # said once, a fill is an altered word
    ]
    for fills, leaked, again in cases:
        assert tuple(map(bool, _both([text.format(*fills)], items))) == (leaked, again), fills
    kinds = np.array([5, 6, 7, 8, 9, leakage._NAME, leakage._NAME, leakage._NUMBER])
    there = "a b c d e melvor melvor 4".split()
    for here, want in (("zan zan 4", True), ("zan quor 4", False), ("zan melvor 5", False), ("melvor melvor 5", True), ("melvor melvr 5", False), ("melvor melvor 4", False)):
        assert leakage._other_fills(there, "a b c d e".split() + here.split(), kinds, kinds) is want, here


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 10)
    monkeypatch.setattr(leakage, "CHUNK", 50)
    docs = spark.createDataFrame([(i, ITEM if i % 2 else OTHER) for i in range(12)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "x y z")], "item_id bigint, text string")
    assert sorted(map(tuple, leakage.leaks(docs, bench).collect())) == [(i, 1 if i % 2 else 2) for i in range(12)]


def test_leak_windows_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(300):
        same = r.random(r.integers(0, 60)) < 0.88
        n = len(same)
        want = any(same[a] and same[b - 1] and 8 * (~same[a:b]).sum() <= b - a for a in range(n) for b in range(a + 15, n + 1))
        assert leakage.has_passage(same) == want


# --- 9: personal -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Regards,\nDr. Osric E. Thistlemere We ran", [("name", "Osric E. Thistlemere")]),
        ("Please call bertil selová on tel:+44 7700 900 030 now", [("name", "bertil selová"), ("phone", "+44 7700 900 030")]),
        ("mail=mailto:a.b+c@eu.x.example; ok", [("email", "a.b+c@eu.x.example")]), ("x_1 [at] mail [dot] inbox [dot] test svp", [("email", "x_1 [at] mail [dot] inbox [dot] test")]),
        ("ada@x.test​ is", [("email", "ada@x.test")]), ("a＠x.test", [("email", "a＠x.test")]), ("Icons sprite@2x.png use @media probe-kit@1.4.1", []),
        ("SSN 666-42-9007 was, 666931497", [("id_number", "666-42-9007")]), ("My number QQ 30 30 44 C here", [("id_number", "QQ 30 30 44 C")]), ("Number 1 46 99 00 636 738 42.", [("id_number", "1 46 99 00 636 738 42")]),
        ("Order 74-15-082, range 840-1253, 192.0.2.184:8390, v1.28.834, id 55427313", []), ("call (415) 555-0114 or 0171/3920069", [("phone", "(415) 555-0114"), ("phone", "0171/3920069")]),
        ("to 27 Old Kiln Lane\nSaint-Orvin, QX5 2ZZ in March", [("address", "27 Old Kiln Lane\nSaint-Orvin, QX5 2ZZ")]), ("Adresse: Am Alten Speicher 153a - 00265 Ralselton Unser", [("address", "Am Alten Speicher 153a - 00265 Ralselton")]),
        ("na Pod Javory 5/4, 000 70 Horní Lipkov Náš", [("address", "Pod Javory 5/4, 000 70 Horní Lipkov")]), ("<td>Kvapil, Ansel</td><td>99.408.618-L</td>", [("name", "Kvapil, Ansel"), ("id_number", "99.408.618-L")]),
        ("担当：佐野川 みのり\n電話：01 99 00 37 35", [("name", "佐野川 みのり"), ("phone", "01 99 00 37 35")]), ("", []), ("zero two one four four six zero one two three, ok", []),
        ("call plus 0 two three now, zero one seven one three nine two zero zero six nine. Bye", []), ("SSN six six six nine three one four nine seven was", [("id_number", "six six six nine three one four nine seven")]),
    ],
)
def test_personal(text, want):
    got = [(k, text[a:b]) for a, b, k in personal.find(text, frozenset({"Horní Lipkov"}))]
    assert sorted(got) == sorted(want)


def test_personal_of_any_length():
    local = "a" * 150
    assert personal.find(f"x {local}.b@c.test y") == [(2, 161, "email")]
    assert [(k, a) for a, _, k in personal.find(f"{local} [dot] {local}@c.test")] == [("email", 0)]
    street = "27 " + "Kiln" * 60 + " Lane\nSaint-Orvin, QX5 2ZZ"
    assert personal.find(f"to {street} in") == [(3, 3 + len(street), "address")]
    gap = " " * 300
    assert personal.find(f"SSN{gap}666931497") == [(303, 312, "id_number")]
    assert personal.find(f"<td>a</td>{gap}<td>{gap}666931497") == [(614, 623, "id_number")]
    name = "Maria" * 30 + " Gonzalez"
    assert personal.find(f"{name} <a.b@c.test>") == [(0, len(name), "name"), (len(name) + 2, len(name) + 12, "email")]
    assert personal.find("ion.rusu@firma.md wrote") == [(0, 17, "email")]


@pytest.mark.parametrize("text", ["Please meet Maria Gonzalez at", "Yesterday John Smith said that", "I spoke with Anna Novak about", "then Dr. Eva Horn left"])
def test_names_in_running_text(text):
    (found,) = personal.find(text)
    assert text[found[0] : found[1]] in ("Maria Gonzalez", "John Smith", "Anna Novak", "Eva Horn")


def test_towns_by_join(spark):
    texts = ["to 27 Old Kiln Lane\nHorní Lipkov, QX5 2ZZ in", "na Pod Javory 5/4, 000 70 Horní Lipkov Náš", "na Pod Javory 5/4, 000 70 Brno Náš"]
    df = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (None, texts[0])], "doc_id bigint, text string")
    got = sorted(texts[r.doc_id][r.start_char : r.end_char] for r in personal.found(df.where("doc_id is not null")).collect())
    assert got == ["27 Old Kiln Lane\nHorní Lipkov, QX5 2ZZ", "Pod Javory 5/4, 000 70 Brno", *["Pod Javory 5/4, 000 70 Horní Lipkov"] * 2]
    assert sorted((r.doc_id is None, r.text) for r in personal.redacted(df).collect()) == sorted([(False, "to [ADDRESS] in"), (True, "to [ADDRESS] in"), *[(False, "na [ADDRESS] Náš")] * 3])


def test_redaction(spark):
    df = spark.createDataFrame([(1, "Please call Ansel Kvapil on 07700 900751 now"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in personal.redacted(df).collect()} == {1: "Please call [NAME] on [PHONE] now", 2: None, 3: ""}
    assert [tuple(r) for r in personal.found(df).orderBy("start_char").collect()] == [(1, 12, 24, "name"), (1, 28, 40, "phone")]
    assert personal.found(df.limit(0)).count() == 0


def test_queries_run(spark, data):
    for name, q in queries.queries().items():
        df = q(spark, data)
        assert df.count() >= 0, name
