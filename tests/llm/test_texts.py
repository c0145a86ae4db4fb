import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import html_text, language_id, pii
from lineloom.llm.registry import QUERIES

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(documents):
    random.seed(3)
    parts = [*"0123456789@@..--++() ab%_\n", "1.2.3.4", "@a.b", "4539578763621486", "+1 (", "000255"]
    texts = [r["text"] for r in documents.collect()] + ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(20_000)]
    for t in texts:
        assert pii.detect(t) == base_spans(t), t
        assert [s[:3] for s in pii.spans(t) if s[3]] == base_spans(t)


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("mail joe [at] example [dot] com now", "email", "joe [at] example [dot] com"),
        ("to joe at example dot com.", "email", "joe at example dot com"),
        ("јое@ехаmple.com", "email", "јое@ехаmple.com"),
        ("x j​oe@exam​ple.com", "email", "j​oe@exam​ple.com"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one two one two five five five zero one nine nine ok", "phone", "plus one two one two five five five zero one nine nine"),
        ("four five three nine five seven eight seven six three six two one four eight six", "card", "four five three nine five seven eight seven six three six two one four eight six"),
        ("at 1 9 2 dot one six eight dot one dot five", "ip", "1 9 2 dot one six eight dot one dot five"),
        ("ip １９２.１６８.０.１!", "ip", "１９２.１６８.０.１"),
    ],
)
def test_disguises(text, kind, part):
    at = text.index(part)
    assert pii.spans(text) == [(kind, at, at + len(part), False)]
    assert part not in pii.redacted(text, pii.spans(text)) and f"[{kind.upper()}]" in pii.redacted(text, pii.spans(text))


@pytest.mark.parametrize("text", ["we meet at noon dot", "one two three four", "the point at issue", "at home. He left", "Привет, как дела", "a @ b", "version 1.2.3"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "a" * 300_000 + "@", "one " * 50_000, "[at] " * 50_000):
        pii.spans(t)


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("Call +1 five five five 010 9999", "phone", "+1 five five five 010 9999"),
        ("joe at example\ndot com", "email", "joe at example\ndot com"),
        ("joe@\texample.com", "email", "joe@\texample.com"),
    ],
)
def test_few_words_and_any_white_space(text, kind, part):
    at = text.index(part)
    assert pii.spans(text) == [(kind, at, at + len(part), False)]


def test_texts_that_are_not_normalised_would_not_change(documents):
    random.seed(4)
    parts = ["one", "Two", " at ", "-at-", "_dot_", "e.com", "12 ", "fünf", "ſix", "plus", "dot", "POİNT", "at", "@", ".", "[", ")", "<", " ", " ", "\n", "\t", "\x1c", "\u2003", ",", "-", "1", "a", "com", "\ue000", "е", "\u200b"]
    texts = [r["text"] for r in documents.collect()] + ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(50_000)]
    assert [t for t in texts if t and not pii.disguised(t) and pii.normalise(t).text != t] == []
    for t in (" " * 300_000 + "(", "1 2" + " " * 300_000, "1 2(" + "\n" * 300_000 + "x"):
        pii.spans(t)


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("write to jane at example.com soon", "email", "jane at example.com"),
        ("to jane-at-example-dot-com, thanks", "email", "jane-at-example-dot-com"),
        ("to jane_at_mail_dot_example_dot_com, thanks", "email", "jane_at_mail_dot_example_dot_com"),
        ("card 4539 5787 6362 148 six here", "card", "4539 5787 6362 148 six"),
        ("card four 539 5787 6362 1486 here", "card", "four 539 5787 6362 1486"),
        ("jane at\nexample\ndot\ncom", "email", "jane at\nexample\ndot\ncom"),
        ("call +4 nine 1 5 1 2 3 4 5 6 7", "phone", "+4 nine 1 5 1 2 3 4 5 6 7"),
    ],
)
def test_words_beside_signs_and_digits(text, kind, part):
    at = text.index(part)
    assert (kind, at, at + len(part), False) in pii.spans(text)
    assert part not in pii.redacted(text, pii.spans(text))


@pytest.mark.parametrize("text", ["visit us at example.com today", "more at example.org", "we met at noon.Then we left", "state-of-the-art-at-home", "in 2020 one of them won"])
def test_places_are_no_addresses(text):
    assert pii.spans(text) == []


def disguise(rng):
    """(kind, disguised identifier), by a random choice of the disguises that the operator knows."""
    kind = rng.choice(["email", "ip", "card", "phone"])
    words = lambda: [rng.choice(w) for w in pii.DIGIT_WORDS]
    spell = lambda digits, share: " ".join(words()[int(c)] if rng.random() < share else c for c in digits)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if rng.random() < 0.5 and "!" <= c <= "~" else c for c in t)
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at}\n", " {dot} "), ("\tat\n", "\ndot\t"), ("-at-", "-dot-"), ("_AT_", "_DOT_"), (" @ ", "."), ("@", " dot "), (" at ", "."), ("<at>", ".")])
        made = f"j{rng.randint(1, 99)}{at}{rng.choice(['example', 'mail7'])}{dot}{rng.choice(['com', 'org', 'de'])}"
        return kind, wide(made) if at == "@" else made
    if kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return kind, rng.choice([wide(".".join(parts)), " dot ".join(spell(x, 0.9) for x in parts), "\u200b.".join(parts)])
    if kind == "card":
        digits = "".join(rng.choices("0123456789", k=15))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        return kind, rng.choice([spell(digits, 0.7), wide(digits), f"{digits[:4]} {digits[4:8]} {digits[8:12]} {digits[12:15]} {words()[int(digits[15])]}", digits[:8] + "\u200b" + digits[8:]])
    digits = "".join(rng.choices("123456789", k=rng.randint(9, 13)))
    return kind, rng.choice(["plus " + spell(digits, 1.0), "+" + digits[:2] + " " + spell(digits[2:], 0.9), wide("+") + digits])


def test_random_disguises_are_found_and_redacted():
    rng, missed = random.Random(8), []
    for _ in range(20_000):
        kind, made = disguise(rng)
        text = f"So {rng.choice(['write', 'then: call', 'it is', 'that was;'])} ({made}) {rng.choice(['ok', 'or not', '. Bye'])}"
        at = text.index(made)
        found = pii.spans(text)
        if not any(k == kind and a <= at and b >= at + len(made) for k, a, b, _ in found) or made in pii.redacted(text, found):
            missed.append(text)
    assert missed == []


def test_pii_frames(odd, clashing, empty):
    for df in (odd, clashing):
        assert len(pii.find_personal_data(df).collect()) == df.count()
        assert pii.redact(df).columns == df.columns
        assert sorted(map(str, pii.redact(df).collect())) == sorted(map(str, df.collect()))
    assert pii.find_personal_data(empty).count() == 0 and pii.redact(empty).count() == 0


def test_pii_query(spark, small):
    import hashlib

    rows = {r["doc_id"]: r for r in QUERIES["op6_personal_data"](spark, small).collect()}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        want = base_spans(d["text"] or "")
        r = rows[d["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r["spans"].split(",")) | {""}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and on others.</div>
<article><h1>A &amp; title</h1><p>The   first&nbsp;paragraph of the text is <b>lo</b>ng enough to count as prose, and it has the words of prose.</p>
<p>Short.<p>Not closed<br>but it goes on &lt;here&gt;</p><div class="ad">Buy now</div><form><label>Mail</label></form><section id="comments"><p>I liked the text that you have written here very much indeed, and I would like more of it.</p></section></article>
<aside>Side</aside><footer>&copy; someone</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "A & title The first paragraph of the text is long enough to count as prose, and it has the words of prose. Short. Not closed but it goes on <here>"


def test_page_without_article():
    prose = "It is the kind of text that has all of the words which are in any language, and so it is taken to be the text of the page. " * 2
    page = f"<body><div><a href=x>Home</a> <a href=y>About</a></div><h2>Title</h2><p>{prose}</p><p>Short one.</p><p>{prose}</p><div><a href=z>Next</a></div></body>"
    got = html_text.main_text(page)
    assert got == " ".join(["Title", prose.strip(), "Short one.", prose.strip()])


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<a href='", "<!--", "<script>", "<p>" * 5000, "</p>" * 5000, "<b>" * 20_000 + "x", "&amp;&#x41;&nosuch;", "<article></article>"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_equal_their_articles(spark, small):
    from html import unescape

    for r in QUERIES["op7_main_text"](spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        want = " ".join(unescape(re.sub(r"<(?:/?(?:p|h1)|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)


P = "It is the kind of text that has all of the words which are in any language, and so it is taken to be the text of the page. " * 2
WANT = f"T {P}Short one."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><nav><a href=a>Home</a></nav><div class="no-sidebar"><h1>T</h1><p>{P}</p><p>Short one.</p></div></body>', WANT),
        (f'<body><div class="has-sidebar"><h1>T</h1><p>{P}</p><p>Short one.</p></div><footer>The end of it</footer></body>', WANT),
        (f'<body class="header-fixed"><div class="header-fixed"><h1>T</h1><p>{P}</p><p>Short one.</p></div></body>', WANT),
        (f'<form id="all"><div><nav><a href=a>Home</a></nav><h1>T</h1><p>{P}</p><p>Short one.</p></div></form>', WANT),
        (f'<body><aside><p>{P}</p></aside><article><h1>T</h1><p>{P}{P}</p></article></body>', f"T {P}{P}"),
        (f'<body><article><h1>T</h1><p>{P}</p><p>Share this</p><p><a href=q>Read more</a></p><p>Tags: <a href=a>a</a>, <a href=b>b</a></p><p>Short one.</p><p>Tags: a, b</p></article></body>', WANT),
        (f'<body><article><h1>T</h1><p>{P}</p><p>Short one.</p></article><div id="comments"><article class="comment"><p>{P * 9}</p></article></div></body>', WANT),
        (f'<body><article><h1>T</h1><p>{P}</p><ul><li><a href=1>Another text of ours</a></li><li><a href=2>And one more</a></li></ul><p>Short one.</p></article></body>', WANT),
        (f'<body><article><h1>T</h1><p>{P}</p><table><tr><td>A</td><td>1</td></tr></table><ul><li>one</li></ul></article><footer>x the of</footer></body>', f"T {P}A 1 one"),
        ("<body><article><p>" + "日本語のテキスト。" * 40 + "</p></article></body>", "日本語のテキスト。" * 40),
        ("<body><nav><a href=a>Home</a></nav><h1>T</h1><p>Few words.</p></body>", "T Few words."),
    ],
)
def test_sections_are_evidence(page, want):
    assert html_text.main_text(page) == " ".join(want.split())


def test_teaser_article_does_not_hide_the_text():
    got = html_text.main_text(f'<body><article class="teaser"><h3>Other</h3><p><a href=x>Read more</a></p></article><div>{"".join(f"<p>{P}</p>" for _ in range(7))}</div></body>')
    assert got.count("It is the kind") == 14 and "Read more" not in got


def bare(html):
    """A page whose tags and classes say nothing of its sections, but for the footer."""
    for tag in ("article", "nav"):
        html = html.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return html


def test_statistics_decide(spark, small, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = [html_text.main_text(p) for p in pages]
    same = lambda made: np.mean([a == b for a, b in zip(right, made, strict=True)])
    assert same([html_text.main_text(bare(p)) for p in pages]) > 0.96
    with monkeypatch.context() as m:
        m.setattr(html_text, "STOP_WORDS", frozenset())
        assert same([html_text.main_text(p) for p in pages]) > 0.99  # as pages of a language that no list has
    with monkeypatch.context() as m:
        m.setattr(html_text, "LINKS", 2)
        assert same([html_text.main_text(bare(p)) for p in pages]) < 1
        assert "Another" in html_text.main_text(f"<body><p>{P}</p><ul><li><a href=1>Another text of ours</a></li></ul><p>{P}</p></body>")
    names = f"<body><div><p>{' '.join('abc' + chr(97 + i) + 'xyz'[i % 3] * i for i in range(26))}</p></div><h1>T</h1></body>"
    assert html_text.main_text(names).endswith("T")
    beside = f"<body><p>{P}</p><p>{P}</p><div><p>{' '.join('abc' + chr(97 + i) + 'xyz'[i % 3] * i for i in range(26))}</p></div><h1>T</h1></body>"
    assert "abcb" not in html_text.main_text(beside)  # density tells it from the prose around
    with monkeypatch.context() as m:
        m.setattr(html_text, "LONG", 1 << 30)
        assert "abcb" in html_text.main_text(beside)


#: Prose in languages whose words no list has.
ELSEWHERE = {
    "Finnish": "Kaupungin vanhassa keskustassa avattiin eilen uusi kirjasto, jota asukkaat olivat odottaneet yli kymmenen vuotta. Rakennuksen suunnitteli nuori arkkitehti, joka kertoi halunneensa tuoda valoa jokaiseen huoneeseen. Avajaisiin saapui satoja ihmisiä, ja jonot ulottuivat torille saakka.",
    "Polish": "Wczoraj otwarto nową bibliotekę, na którą mieszkańcy czekali ponad dziesięć lat. Budynek zaprojektowała młoda architektka, która chciała wpuścić światło każdym oknem. Przyszły setki osób, kolejka sięgała rynku, dzieci zaś dostały pierwsze karty czytelnika wraz drobnymi upominkami.",
    "Turkish": "Kentin eski merkezinde dün yeni kütüphane açıldı, sakinler bunu yıllardır bekliyordu. Binayı genç mimar tasarladı, her odaya ışık getirmek istediğini söyledi. Açılışa yüzlerce kişi geldi, kuyruk meydana kadar uzandı, çocuklara ilk okuyucu kartları dağıtıldı.",
    "Indonesian": "Perpustakaan baru dibuka kemarin dekat alun-alun kota setelah warga menunggu lebih dari sepuluh tahun. Arsitek muda merancang gedung itu supaya cahaya masuk hingga setiap ruangan. Ratusan orang datang, antrean mencapai pasar, anak-anak menerima kartu anggota pertama mereka.",
    "Swedish": "Igår öppnades stadens nya bibliotek efter över tio års väntan. Byggnaden ritades av ung arkitekt, vilken ville släppa in ljus genom varje fönster. Hundratals invånare kom dit, kön sträckte sig ända bort till torget, barnen fick sina första lånekort samt små gåvor.",
    "Vietnamese": "Hôm qua thư viện mới được khánh thành giữa trung tâm thành phố sau hơn mười năm chờ đợi. Kiến trúc sư trẻ thiết kế tòa nhà muốn đưa ánh sáng vào mọi căn phòng. Hàng trăm người dân tới dự, hàng dài kéo đến quảng trường, trẻ nhỏ nhận thẻ đọc đầu tiên.",
    "names": "Aaltonen Virtanen Korhonen Mäkinen Nieminen Mäkelä Hämäläinen Laine Heikkinen Koskinen Järvinen Lehtonen Lehtinen Saarinen Salminen Heinonen Niemi Heikkilä Kinnunen Salonen Turunen Salo Laitinen Tuominen Rantanen Karjalainen Jokinen Mattila Savolainen",
    "sheet": "Display 6.1 inch OLED 2532x1170 pixels; Processor A15 hexacore 3.2 GHz; Memory 6 GB LPDDR4X; Storage 128/256/512 GB; Camera 12 MP f/1.5 + 12 MP f/2.4; Battery 3240 mAh, charging 20 W; Weight 174 g; Dimensions 146.7 x 71.5 x 7.65 mm; Ports Lightning; Radio 5G, WiFi 6, Bluetooth 5.0",
}


@pytest.mark.parametrize("language", ELSEWHERE)
@pytest.mark.parametrize("wrap", ["{}", "<article>{}</article>", "<main>{}</main>", "<div><section>{}</section></div>"])
@pytest.mark.parametrize("times", [1, 2])
def test_pages_of_any_language_keep_their_text(language, wrap, times):
    text = ELSEWHERE[language]
    assert len(text) >= html_text.LONG
    body = "".join(f"<p>{text}</p>" for _ in range(times))
    page = f"<html><body><nav><ul><li><a href='/a'>Etusivu</a></li><li><a href='/b'>Uutiset</a></li></ul></nav>{wrap.format(f'<h1>Title</h1>{body}')}<footer>© 2024 Sivusto. {text[:80]}</footer></body></html>"
    assert html_text.main_text(page) == " ".join(["Title", *[text] * times])


@pytest.mark.parametrize("language", ["Finnish", "Turkish"])
def test_a_notice_in_a_listed_language_takes_no_text_away(language):
    text = ELSEWHERE[language]
    page = f"<body><p>{text}</p><p>{text}</p><div class='cookie-notice'><p>{P}</p></div></body>"
    assert html_text.main_text(page) == f"{text} {text}"


def test_very_long_and_deep_pages():
    assert html_text.main_text(f"<article>{f'<p>{P}</p>' * 20_000}</article>") == (P * 20_000).strip()
    assert html_text.main_text("<div>x" * 50_000).count("x") == 50_000
    assert html_text.main_text("<div class=ad>x" * 50_000) == ""


def test_page_query_takes_odd_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "v", f"<p>{P}</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"] or 0, r["n_chars"], r["text"]) for r in QUERIES["op7_main_text"](spark, str(tmp_path)).collect()), key=str)
    want = html_text.main_text(PAGE)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, len(want), want), (3, len(want), want), (0, len(P.strip()), P.strip())], key=str)


def test_html_frames(clashing, empty):
    assert html_text.extract(clashing, "text", "spans").count() == clashing.count()
    assert html_text.extract(empty, "text", "main").count() == 0


def slow_cost(word, samples, order):
    """Code length of one token by counting contexts in dictionaries, symbol by symbol."""
    counts = {}
    for token in b" ".join(samples).split():
        s = b" " + token + b" "
        for i in range(1, len(s)):
            for d in range(order + 1):
                if d <= i:
                    counts.setdefault(s[i - d : i], {}).setdefault(s[i], 0)
                    counts[s[i - d : i]][s[i]] += 1
    bits, s = 0.0, b" " + word + b" "
    for i in range(1, len(s)):
        out = set()
        for d in range(min(order, i), -1, -1):
            c = counts.get(s[i - d : i])
            if not c:
                continue
            rest = {x: n for x, n in c.items() if x not in out}
            n, q = sum(rest.values()), len(rest)
            if s[i] in rest:
                bits += np.log2((n + q) / rest[s[i]])
                break
            if q:
                bits += np.log2((n + q) / q)
            out |= set(c)
        else:
            bits += np.log2(256 - len(out))
    return bits


def test_code_lengths_equal_brute_force():
    random.seed(6)
    texts = {"a": [" ".join("".join(random.choices("abcde", k=random.randint(1, 7))) for _ in range(80))], "b": [" ".join("".join(random.choices("cdefg", k=random.randint(1, 7))) for _ in range(60))]}
    model = language_id.fit([(k, t) for k, ts in texts.items() for t in ts])
    words = [b"abc", b"ddd", b"gfe", b"zz", b"a", "é".encode(), b"abcdeabcde", b"edcba"]
    got = model.costs(words)
    for i, w in enumerate(words):
        for j, k in enumerate(("a", "b")):
            assert got[i, j] == pytest.approx(slow_cost(w, [t.encode() for t in texts[k]], language_id.ORDER), rel=1e-5)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(d, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_frames(spark, odd, clashing, empty):
    model = language_id.train(odd.where("doc_id in (4, 8)"), "doc_id")
    for df in (odd, clashing):
        rows = language_id.predict(df, model).collect()
        assert len(rows) == df.count()
        und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
        assert und == {1, 2, 3, 6} and all(0 <= r["score"] <= 1 for r in rows)
    none = language_id.train(empty, "doc_id")
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_training_sample_is_bounded(documents):
    few = language_id.sample(documents, "doc_id", docs=5, size=20_000).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    assert len(few) == 4 and all(r["n"] <= 5 and r["b"] <= 20_000 for r in few)
