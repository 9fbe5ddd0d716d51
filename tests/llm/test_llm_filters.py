"""Html extraction, url filters, personal data and quality rules against brute force."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import awkward, prose, same_rows

from millrace.llm import html_text, pii, quality, url_filter
from millrace.llm.crf import KINDS, LABELS, N, Crf, Decoder
from millrace.llm.pages import Page

BLOCKS = ["A title &amp; more", "First  paragraph\n of the <b>text</b>, long enough to count.", "Second &lt;one&gt; with a <a href='/x'>link</a> in it and&nbsp;more.", "Last line"]
TEXT = "A title & more\nFirst paragraph of the text, long enough to count.\nSecond <one> with a link in it and more.\nLast line"
BODY = f"<h1>{BLOCKS[0]}</h1>" + "".join(f"<p class='p{k}'>{b}</p>" for k, b in enumerate(BLOCKS[1:]))
JUNK = {
    "menu": "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>",
    "top": "<header><h1>The site of all sites</h1><p>The motto of the site, which is quite long and says nothing.</p></header>",
    "side": "<aside><p>Other things that you may like to read some day soon</p></aside>",
    "ad": '<div class="ad"><p>Buy this now, it is cheap and good and cheap and good and cheap.</p></div>',
    "cookie": '<div id="cookie-notice">We use cookies to make this site better for all of us.</div>',
    "form": "<form><label>Your name</label><textarea>nothing</textarea><button>Send</button></form>",
    "code": "<script>var a = '<p>not a text</p>';</script><style>p > a { color: red }</style><noscript><p>Turn it on</p></noscript>",
    "comments": '<section class="comments"><h3>Comments</h3><p>I have read all of this and I do not agree with a word of it.</p><p>Nor do I, as I have said before, but who listens to me here?</p></section>',
    "footer": "<footer><p>All rights reserved by the owners of all rights to this very page</p></footer>",
    "hidden": "<div hidden><p>not to be seen by anyone who reads this page at all</p></div><!-- <p>a comment</p> -->",
}
FRAMES = [
    "<html><body>{top}{menu}<article>{body}{ad}</article>{side}{comments}{footer}</body></html>",
    "<body><div id=wrap12>{top}{menu}<div class='col main-content'>{code}{body}{form}</div><div class='sidebar'>{side}<p>More of it here, and there, and all over the place.</p></div>{comments}{footer}",
    "<div class=page><div class='header'><p>A header made of a div, long enough to look like a text.</p></div><div class=x7><div class=y9>{body}{hidden}</div></div><div class='footer'><p>Imprint and more</p></div></div>{cookie}",
    "<body class='has-sidebar'><div class='content with-sidebar'>{body}</div><div class='ad-slot'>{ad}</div><div class='user-comments'>{comments}</div><p class='copyright'>No right reserved</p></body>",
    "<main>{cookie}<div><section>{body}</section></div></main>{menu}{footer}",
]


@pytest.mark.parametrize("frame", FRAMES)
def test_text_of_templates(frame):
    assert html_text.extract(frame.format(body=BODY, **JUNK), None) == TEXT


def test_broken_html():
    assert html_text.extract("<article><h1>T</h1><p><b>One two.<br><p>Three</p></article><footer>&copy; x", None) == "T\nOne two.\nThree"
    assert html_text.extract("plain text & more", None) == "plain text & more"
    assert html_text.extract("<p title=it's>a</p><p title='x>y'>b</p><p x=\"never closed>c</p>", None) == "a\nb\nc"
    assert html_text.extract("<p>a<script>never closed <p>b", None) == "a"
    assert html_text.extract("<p>1 < 2 and 3 > 2 &#65;&#x42;</p><!-- never closed <p>x", None) == "1 < 2 and 3 > 2 AB"
    for source in (None, "", "<", "<p", "</p>", "<!--", "<div>" * 5000, "<p>" * 5000, "<a b=" * 3000):
        assert isinstance(html_text.extract(source, "/div"), str)


WHOLE = [
    "<article data-hidden='false'>{}</article>",
    "<article title='The hidden valley'>{}</article>",
    "<div data-id='sidebar'>{}</div>",
    "<div class='page--no-sidebar'>{}</div>",
    "<div class='content-with-sidebar'>{}</div>",
    "<div class='layout-header-fixed'>{}</div>",
    "<div class='news-alert-story'>{}</div>",
    "<form id='page-form' action='x'><article>{}</article></form>",
    "<form id='page-form' action='x'><div>{}</div></form>",
    "<div class=nav><a href=/>Home</a><article>{}</article>",
    "<div class='widget'>{}</div>",
]


@pytest.mark.parametrize("frame", WHOLE)
@pytest.mark.parametrize("around", ["<html><body>{}{menu}{footer}</body></html>", "<body>{menu}{comments}{cookie}{}</body>"])
def test_names_do_not_take_the_article(frame, around):
    assert html_text.extract(around.format(frame.format(BODY), **JUNK), None) == TEXT


def test_pages_without_an_article_are_empty():
    assert html_text.extract("<body>{menu}{cookie}{comments}{form}{footer}".format(**JUNK), None) == ""
    long = JUNK["comments"].replace("comments", "post-comments") * 20
    assert html_text.extract(f"<body><div class=x>{BODY}</div>{long}", None) == TEXT


def test_bad_html_takes_time_in_proportion():
    start = time.monotonic()
    html_text.extract("<div>" * 50_000 + "</section>" * 75_000, None)
    html_text.extract("<div class=sidebar>" * 20_000 + "<article>x" * 20_000 + "</article>" * 20_000, None)
    assert time.monotonic() - start < 10


def slow_winners(rows):
    """Host -> path with the most votes, page after page."""
    votes = {}
    for host, source in rows:
        page = Page(source)
        totals = page.scores()
        for path, score in zip(page.path, totals, strict=True):
            if score:
                of_host = votes.setdefault(host, {})
                of_host[path] = of_host.get(path, 0) + html_text.VOTES * score // sum(totals)
    return {host: min(paths, key=lambda p: (-paths[p], p)) for host, paths in votes.items()}


def test_winners_against_counting(spark):
    rows = [(r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()]
    rows += [(f"http://x.org/{k}", f"<div class='a{k % 3}'>{BODY}</div><div class='b'><p>{'more ' * 5 * k}</p></div>".replace("a2", "c")) for k in range(9)] + [(None, BODY), ("y", None)]
    hosts = [(re.match(r"[^:]*://([^/?#]*)|", url or "")[1] or "" if url and "://" in url else "", source) for url, source in rows]
    hosts = [(h.lower(), source) for h, source in hosts]
    got = html_text.winning_paths(spark.createDataFrame(hosts, "host string, html string")).collect()
    assert {r.host: r.path for r in got} == slow_winners(hosts)


def test_hosts_vote_for_a_path(spark):
    frame = "<div class='a'>{0}</div><div class='b'>{1}</div>"
    article, teaser = "".join(f"<p>{prose(random.Random(k), 40)}</p>" for k in range(3)), "<p>" + prose(random.Random(9), 10) + "</p>"
    rows = [(k, f"http://x.org/{k}", frame.format(teaser, article)) for k in range(5)]
    rows += [(5, "http://x.org/5", frame.format("<p>" + prose(random.Random(10), 12) + "</p>", "<p>few words, but some all the same</p>"))]  # its own best is .a; the host's is .b
    rows += [(6, "http://X.org/6", frame.format(article, "<p>x</p>")), (7, "http://x.org/7", "<table><tr><td>alone</table>"), (8, None, None), (8, None, None), (9, "y", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("host", F.lit("h"))
    got = html_text.main_text(df, source="html")
    assert got.columns == ["page_id", "url", "html", "host", "text"]
    texts = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert texts[0] == "\n".join(Page("<body>" + article).text({0}).split("\n"))
    assert texts[5] == "few words, but some all the same" and texts[7] == "alone" and texts[8] == texts[9] == ""
    assert len(texts[6]) > 100  # its own container wins clearly
    assert html_text.main_text(df.limit(0)).count() == 0


def slow_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules(spark, seed):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "aa", "org", "b-c"], ["/", "/x", "/xy", "/x/", "/x/y", "", "/é"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randrange(1, 4)))
    rules = list({(host(), rng.choice(parts) + rng.choice(["", "z", "/1"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host().upper() if rng.random() < 0.2 else host()}{rng.choice(parts)}{rng.choice(['', 'z', '/1', '/12?q=a://b.org/x', '#/x', '?x'])}" for _ in range(400)]
    urls += [None, "", "org/x", "://", "x://org", "x:///x", "x://a..org/x", "x://.org/", "x://org./x"] + urls[:50] + ["http://hot.org/x"] * 200
    df = spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate(urls)], "page_id long, url string, rule string, part int")
    extra = [(None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("a", "/", "no verdict"), *[(h, p, "allow") for h, p, v in rules[:5]]]
    own = spark.createDataFrame(rules + extra, "host string, path string, verdict string")
    known = Counter()
    for h, p, v in rules + [("org", "", "block"), *[(h, p, "allow") for h, p, v in rules[:5]]]:
        known[h, p] = max(known[h, p] or "", v)
    listed = [(h, p, v) for (h, p), v in known.items()]
    got = url_filter.filter_urls(df, own)
    assert got.columns == ["page_id", "url", "part", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == slow_verdict(r.url, listed), r.url
    assert {r.verdict for r in url_filter.filter_urls(df, own.limit(0), default="block").collect()} == {"block"}
    assert url_filter.filter_urls(df.limit(0), own).count() == 0


def test_url_plan_has_no_python(spark):
    from conftest import SF_DIR

    from millrace.llm.queries import QUERIES

    plan = QUERIES["op2_url_filter"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                yield kind, m.start(), m.end()


def test_base_spans_of_odd_texts():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x", ".y", "..", "%", "+", "-", " ", "1", "12", "255", "256", "0", ".", "(", ")", "4111111111111111", "4111 1111-1111 1111", "+49 30 1234567", "é", "٣", "\n", "00000255"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert list(pii.base_spans(text)) == list(slow_base(text)), repr(text)


def test_long_runs_take_no_quadratic_time():
    for text in ("1" * 300_000, "1." * 100_000, "a" * 300_000 + "@", "a@" * 100_000, "+1 " * 100_000, "+" * 300_000):
        list(pii.base_spans(text))


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(pii.labelled(spark))


def test_the_field_finds_held_out_forms(spark):
    """Precision and recall of the added spans over four parts of the labelled table, each held out once."""
    mark = re.compile(rf"\[({'|'.join(KINDS)}):((?:[^\[\]]|\[\w+\])*)\]")
    lines = [r.text for r in pii.labelled(spark).collect()]
    wanted, found, right = 0, 0, 0
    for k in range(4):
        rest = [(line,) for i, line in enumerate(lines) if i % 4 != k]
        model = pii.train(spark.createDataFrame(rest, "text string"))
        rows, gold = [], {}
        for i, line in enumerate(lines[k::4]):
            text, at = "", 0
            for m in mark.finditer(line):
                text += line[at : m.start()] + m[2]
                gold.setdefault(i, set()).add((m[1], len(text) - len(m[2]), len(text)))
                at = m.end()
            rows.append((i, text + line[at:]))
        for r in pii.find(spark.createDataFrame(rows, "id long, text string"), model).collect():
            base = [s for s in r.spans if s.base]
            hard = {g for g in gold.get(r.id, ()) if all(g[2] <= b.start or g[1] >= b.end for b in base)}
            added = {(s.kind, s.start, s.end) for s in r.spans if not s.base}
            wanted, found, right = wanted + len(hard), found + len(added), right + len(added & hard)
    assert wanted > 40 and right >= 0.8 * wanted and right >= 0.9 * found


def test_training_rows_are_learnt_and_new_forms_found(spark, model):
    decoder = Decoder(model)
    for line in pii.LABELLED.strip().splitlines():
        words, labels = pii._tagged(line)
        classes = np.concatenate([[0], decoder.number(words), [0]])
        assert [LABELS[k] for k in decoder.labels(classes)[1:-1]] == labels, line
    held_out = spark.createDataFrame([("ring me on (646) 555-0173 at night",), ("mail to nina at verlag dot de, please",), ("a sum of 1,204.50 in 2022 and version 3.1. of it",), ("number 4921835017265539 of 2020",)], "text string")
    kinds = [[s.kind for s in r.spans] for r in pii.find(held_out, model).collect()]
    assert kinds == [["phone"], ["email"], [], []]


def test_viterbi_finds_the_best_path(model):
    decoder, rng = Decoder(model), random.Random(6)
    words = [w for line in pii.LABELLED.split("\n") for w in line.split()]
    some = [rng.choices(words, k=n) for n in (1, 2, 3, 4, 4)]
    for ws in some:
        own = decoder.number(ws)
        padded = np.concatenate([[0], own, [0]])
        emit = [decoder.tables[padded[t], 0] + decoder.tables[padded[t - 1], 1] + decoder.tables[padded[t + 1], 2] for t in range(1, len(padded) - 1)]
        best = max(np.ndindex(*[N] * len(ws)), key=lambda path: sum(e[k] for e, k in zip(emit, path, strict=True)) + sum(decoder.pairs[a, b] for a, b in zip((0, *path), (*path, 0), strict=True)))
        assert tuple(decoder.labels(padded)[1:-1]) == best


def test_spans_and_masks_of_awkward_rows(spark, model):
    extra = ["é mail a.b@c.de and +1 (212) 555-0199, 10.0.0.1 10.0.0.300", "4111 1111 1111 1111"]
    df = awkward(spark, extra)
    rows = pii.find(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == list(slow_base(r.text))
        assert [(KINDS.index(s.kind), s.start) for s in r.spans] == sorted((KINDS.index(s.kind), s.start) for s in r.spans)
    clean = pii.redact(df, model)
    assert clean.columns == df.columns
    texts = [r.text for r in clean.collect()]
    assert "<card>" in texts and None in texts and "" in texts
    assert any(t and t.startswith("é mail <email> and <phone>") for t in texts)
    assert pii.redact(df.limit(0), model).count() == 0
    assert isinstance(Crf().train([(["a"], ["O"])], rounds=2), Crf)


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    twice = {p for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_measures(spark):
    rng = random.Random(3)
    again = prose(rng, 12)
    df = awkward(spark, [f"{again}\n{again}\n{again}", "a b " * 20, "#*$%&|<> é🙂\n\n \n#\n#", "x\x0by\x0cz\x85w\xa0v"])
    rows = quality.measure(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measures(r.text)


def test_limits_follow_each_group(spark):
    rng = random.Random(7)
    rows = []
    for k in range(900):
        source = ["plain", "code", None][k % 3]
        noise = rng.uniform(0.10, 0.14) if source == "code" else 0.0
        text = prose(rng, 80)
        text += "#" * int(noise * len(text))
        rows.append((k, text, "en", source))
    rows += [(1000, prose(rng, 60) + " " + "#" * 60, "en", "plain"), (1001, prose(rng, 60) + "#" * 60, "en", "code"), (1002, prose(rng, 60), "fr", "rare"), (1003, prose(rng, 60) + "|" * 500, "fr", "rare"), (1004, "too short", "en", "plain"), (1005, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdicts = {r.doc_id: r.kept for r in quality.judge(quality.measure(df)).collect()}
    assert [k for k in range(900) if not verdicts[k]] == []
    assert [verdicts[k] for k in range(1000, 1006)] == [False, True, True, False, False, False]
    kept = quality.apply_rules(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, v in verdicts.items() if v}
    assert quality.apply_rules(df.limit(0)).count() == 0


def test_sketches_are_close_to_quantiles(spark):
    rng = np.random.default_rng(1)
    symbols = rng.lognormal(3, 0.5, 5000).astype(int)
    df = spark.createDataFrame([("en", "s", 100, 1000, int(n), 1, 0, 0) for n in symbols], "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = quality.limits(df).first().limit_symbols
    low, high = np.quantile((symbols + 2 * np.sqrt(symbols + 1)) / 1000, [0.25, 0.75], method="inverted_cdf")
    assert got == pytest.approx(high + quality.REACH * (high - low), rel=0.04)


def slow_kept(rows):
    """doc_id -> kept, and how far the nearest signal is from its limit, by sorting whole groups."""
    signals = {}
    for r in rows:
        n, chars, symbols, dup, repeats = slow_measures(r.text)
        lines = len([line for line in (r.text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")])
        if n >= 20 and 100 * repeats <= 30 * n:
            mean = chars / n
            signals[r.doc_id] = [(symbols / chars, 2 * (symbols + 1) ** 0.5 / chars), (dup / lines, 2 * (dup + 1) ** 0.5 / lines), (mean, mean / n**0.5)]
    groups = {}
    for r in rows:
        if r.doc_id in signals:
            for group in ((r.lang, r.source), r.lang, ()):
                groups.setdefault(group, []).append(signals[r.doc_id])
    out = {}
    for r in rows:
        margin = None
        if r.doc_id in signals:
            group = next((g for g in ((r.lang, r.source), r.lang) if len(groups[g]) >= quality.LEAST), ())
            margins = []
            for k, (value, error) in enumerate(signals[r.doc_id]):
                ordered = sorted(sum(s[k]) for s in groups[group])
                low, high = (ordered[-(-q * len(ordered) // 4) - 1] for q in (1, 3))
                limit = high + quality.REACH * (high - low)
                margins.append((limit - value + error) / limit)
            margin = min(margins)
        out[r.doc_id] = margin
    return out


def test_kept_against_sorted_groups(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(quality.measure(df)).collect()}
    slow = slow_kept(rows)
    assert kept.keys() == slow.keys()
    # A bucket's middle is within a hundredth of its values; the spread counts three times.
    close = [k for k, margin in slow.items() if margin is not None and abs(margin) < 0.08]
    assert [k for k in slow if k not in close and kept[k] != (slow[k] is not None and slow[k] > 0)] == []
    assert len(close) < 0.02 * len(rows) and sum(1 for m in slow.values() if m is not None and m < -0.08) > 20


def test_few_odd_characters_do_not_reject(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 400), "en", "s") for k in range(200)]
    rows += [(1000, prose(rng, 20) + " 5% & more", "en", "s"), (1001, prose(rng, 25) + "\nBye\nBye", "en", "s"), (1002, prose(rng, 60) + "<|>" * 40, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.apply_rules(df).collect()} == {k for k, *_ in rows} - {1002}


def test_rules_keep_awkward_columns(spark):
    df = awkward(spark)
    assert same_rows(quality.apply_rules(df).collect(), [r for r in df.collect() if not (slow_measures(r.text)[0] < 20 or 100 * slow_measures(r.text)[4] > 30 * slow_measures(r.text)[0])])
