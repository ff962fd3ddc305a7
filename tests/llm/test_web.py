"""Operators over pages and conversations."""

import hashlib
import re
import time

import numpy as np

from folioforge.llm import chat, html, urls, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "p", "v") for i, u, h in rows], "page_id long, url string, html string, key string, path string, verdict string")


def rule_table(spark, rules=urls.RULES):
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", v, h + p) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[4], max(fits)[3]) if fits else (None, "allow")


def test_urls_match_brute_force(spark):
    hosts = ["net", "example.net", "a.b.example.net", "example.com", "x.example.com", "org", "a.org", "notnet", "netx", "net.com", "", "EXAMPLE.NET", "a\x01b.net", "é.net"]
    rows = [(i, f"http://{h}{p}?q=/en/", None) for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/en/1", "/de/", "/fr/x#y", "/en"))]
    rows += [(None, None, None), (900, "no scheme", None), (901, "x://", None), (901, "x://", None), (902, "a://b.net/en/ x://c", None), (903, "http://example.net#/en/", None)]
    extra = [*urls.RULES, ("block", "b.example.net", "/en/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/"), ("block", None, "/"), ("allow", "a.org", None)]
    for rules in (urls.RULES, extra):
        for size in (1, 10**6):  # many ranges, then few
            got = urls.judge_urls(pages(spark, rows), rule_table(spark, rules), range_rows=size).collect()
            assert len(got) == len(rows)
            for r in got:
                known = [(v, h, p if p is not None else "/") for v, h, p in rules if h]
                assert (r["rule"], r["verdict"]) == brute_rule(r["host"], r["path"], known)
    assert {(r["host"], r["path"]) for r in got if r["page_id"] in (None, 900, 901)} == {("", "")}
    assert urls.judge_urls(pages(spark, []), rule_table(spark)).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(pages(spark, rows), rule_table(spark).where("host = 'x'")).collect()} == {"allow"}


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 1500
    rows = [(i, f"http://h/{i} é\n", big if i % 3 else ("y" * i if i % 2 else None)) for i in range(300)] + [(None, None, big), (299, "http://again", big)]
    layout = warc.Layout(shard_bytes=60_000, file_bytes=2_000)
    seen = []
    for k in (1, 5):
        folder = str(tmp_path / f"w{k}")
        manifest = warc.write_warc(pages(spark, rows).repartition(k), folder, layout)
        seen.append(sorted((r["final"], r["sha1"], r["records"]) for r in manifest.collect()))
        got = warc.read_warc(manifest, folder).collect()
        assert len(got) == len(rows) and all(r["sound"] for r in got)
    assert seen[0] == seen[1] and len(seen[0]) > 5
    by_id = {r["page_id"]: r for r in got}
    for i, _, body in rows[:300]:
        r, payload = by_id[i], (body or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        again = body == big and i < 299
        assert (r["record_type"], r["refers_to"]) == (("revisit", 299) if again else ("response", None))
        assert bytes(r["payload"]) == (b"" if again else payload)
    assert by_id[None]["record_type"] == "response"
    assert warc.read_warc(warc.write_warc(pages(spark, []), str(tmp_path / "none")), str(tmp_path / "none")).collect() == []


def test_conversations_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|im_end|> é\n"
    rows = [(1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "only"), (None, 0, "assistant", "x"), (3, 1, None, "a"), (3, 1, "assistant", "b"), (3, None, "assistant", "c"), (4, 0, "ro\nle\\n", "t" * 50_000)]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, example int")
    examples = chat.format_conversations(turns).collect()
    replies = [chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in examples if r["conv_id"] == 1]
    assert replies == [odd, ""]
    first = next(r for r in examples if r["conv_id"] == 1 and r["example"] == 0)
    assert chat.parse(first["formatted"]) == [("system", "s"), ("user", odd), ("assistant", odd)]
    assert next(chat.parse(r["formatted"]) for r in examples if r["conv_id"] == 4) == [("ro\nle\\n", "t" * 50_000)]
    got = {r["conv_id"]: r for r in chat.digest_examples(chat.format_conversations(turns)).collect()}
    assert set(got) == {None, 1, 2, 3, 4} and got[2]["loss_chars"] == 0 and got[1]["n_turns"] == 5
    told = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
    assert got[3]["loss_sha256"] == hashlib.sha256(b"cb").hexdigest()
    assert chat.digest_examples(chat.format_conversations(turns.where("conv_id > 9"))).collect() == []


def test_warc_hard_ids_urls_and_folder(spark, tmp_path):
    big = "<p>" + "z" * 2000
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "http://a", big), (most, None, big), (0, "", "x"), (-1, None, None), (most - 1, "http://b", big), (None, None, big)]
    rows += [(77, f"http://c/{k}", f"{k}" * 3000) for k in range(60)] + [(77, "http://same", "s" * 3000)] * 9
    folder = str(tmp_path / "hard")
    manifest = warc.write_warc(pages(spark, rows), folder, warc.Layout(shard_bytes=20_000, file_bytes=50_000))
    got = warc.read_warc(manifest, folder).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["page_id"], r["url"], len(r["payload"])) for r in got), key=key) == sorted(((i, u, len(h or "") if i not in (least, most - 1) else 0) for i, u, h in rows), key=key)
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {least: most, most - 1: most}
    assert len({r["final"][:11] for r in manifest.collect()}) > 8  # one id's rows are spread over shards
    assert not list((tmp_path / "hard" / "_temporary").iterdir())


def test_warc_revisits_are_held_against_their_response(spark):
    rows = [(1, "response", None, 5, "d1", True), (2, "revisit", 1, 5, "d1", True), (3, "revisit", 1, 5, "d2", True), (4, "revisit", 9, 5, "d1", True), (5, "response", None, 5, "d5", False), (6, "revisit", 5, 5, "d5", True), (7, "revisit", 1, 6, "d1", True)]
    records = spark.createDataFrame([(*r, None) for r in rows], "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean, payload binary")
    assert {r["page_id"]: r["sound"] for r in warc.check_revisits(records).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


PAGE = (
    '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Cookies</div><div class="{c}"><h1>Head &amp; more</h1><p>One <b>two</b>\n three &lt;x&gt;.'
    "<p>Four<br>five<ul><li>six<li>seven</ul><form><p>sign</form><div class='comments'><p>Nice words from readers of this page</div></div><div class='sidebar'>side</div><aside>note</aside><footer>foot</footer><script>var a='</p>'</script></body></html>"
)
WANT = "Head & more\n\nOne two three <x>.\n\nFour five\n\nsix\n\nseven"


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.net/{i}", PAGE.replace("{c}", f"post-{i}")) for i in range(6)]
    rows += [(50, "http://h0.net/x", "<p>just text"), (51, None, None), (52, "http://h0.net/y", ""), (None, "u", "<article>A</article>"), (53, "z", "<div" * 3000), (54, "z", "<b>" * 3000 + "deep"), (50, "http://h0.net/x", "<p>just text")]
    got = html.extract_text(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert all(by_id[i]["text"] == WANT and by_id[i]["n_chars"] == len(WANT) for i in range(6))
    assert [by_id[k]["text"] for k in (50, 51, 52, None, 54)] == ["just text", "", "", "A", "deep"]
    assert {r["text"] for r in html.extract_text(pages(spark, rows[:6]), held_bytes=0).collect()} == {WANT}
    assert html.extract_text(pages(spark, [])).collect() == []


def test_html_consensus_rescues_a_thin_page(spark):
    full = '<body><div class="blurb"><p>{b}</p></div><div class="story"><p>{a}</p></div></body>'
    rows = [(i, f"http://h/{i}", full.replace("{a}", "long article text " * 30).replace("{b}", "blurb")) for i in range(5)]
    rows.append((9, "http://h/9", full.replace("{a}", "short").replace("{b}", "a very long advertisement for something " * 9)))
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, rows)).collect()}
    assert got[9] == "short"


def test_html_keeps_what_stands_beside_the_body(spark):
    body, menu = "".join(f"<p>long article text {k}</p>" for k in range(40)), "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"
    core = "\n\n".join(f"long article text {k}" for k in range(40))
    inner = f"<h1>Head</h1><p>Lead<div class=body>{body}</div><p>End<ul><li>last</ul>"
    want = f"Head\n\nLead\n\n{core}\n\nEnd\n\nlast"
    cases = [
        (f"<body><div class=side-a>{menu}</div><article>{inner}</article><p><a href=z>More</a></body>", want),
        (f"<body>{menu}<article>{inner}<p><a href=z>Source</a></article></body>", f"{want}\n\nSource"),
        (f"<body><main><h1>Over</h1><article>{inner}</article>{menu}</main></body>", f"Over\n\n{want}"),
        (f"<body>{menu}<div class=outer><div class=post>{inner}</div></div><div class=blurb><p>blurb</p></div></body>", want),
        (f"<body><div class=post>{inner}{menu}</div></body>", want),
        (f"<body>{inner}</body>", want),
        (f"<body><article><h2>Head</h2><p>Lead</p><blockquote>{body}</blockquote><p>End</article><div class=comments>no</div></body>", f"Head\n\nLead\n\n{core}\n\nEnd"),
        (f"<body><article><h2>Head</h2><section><p>Lead</section><section>{body}</section><nav>no</nav><section>End</section></article></body>", f"Head\n\nLead\n\n{core}\n\nEnd"),
    ]
    rows = [(100 * i + k, f"http://t{i}/{k}", page) for i, (page, _) in enumerate(cases) for k in range(2)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, rows)).collect()}
    assert [got[100 * i + k] for i in range(len(cases)) for k in range(2)] == [text for _, text in cases for _ in range(2)]
    many = "<body>" + "".join(f"<div class=b><p>text {k}</p></div>" for k in range(20_000)) + "</body>"
    page = html.read_page(many)
    assert len(html.text_at(page, page.containers[2].path)) > 200_000


class Tree:
    """An element of a made page: tag, class, id, and what is in it, elements or one text."""

    def __init__(self, tag, inside, label="", ident=""):
        self.tag, self.inside, self.label, self.ident = tag, inside, label, ident

    def html(self):
        body = self.inside if isinstance(self.inside, str) else "".join(x.html() for x in self.inside)
        return f"<{self.tag}{f' class={chr(34)}{self.label}{chr(34)}' if self.label else ''}{f' id={self.ident}' if self.ident else ''}>{body}</{self.tag}>"

    def texts(self, link=False):
        link = link or self.tag == "a"
        if isinstance(self.inside, str):
            return [(self.inside, link)]
        return [t for x in self.inside for t in x.texts(link)]


def made_page(rng):
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    para = lambda n: Tree("p", words(n))
    links = lambda n: [Tree("li", [Tree("a", words(3))]) for _ in range(n)]
    box = Tree("div", [para(int(rng.integers(3, 30)))], f"box-{rng.integers(0, 9)}", "comments" if rng.random() < 0.5 else "")
    more = Tree("div", [Tree("ul", links(int(rng.integers(0, 6)))), para(int(rng.integers(1, 12)))], f"more{rng.integers(0, 9)}")
    article = Tree("article", [Tree("h1", words(4)), Tree("div", [para(int(rng.integers(60, 90))) for _ in range(3)], "body"), box, Tree("ul", links(2), "refs")])
    return Tree("html", [Tree("body", [Tree("nav", [Tree("ul", links(5))]), para(3), more, article, Tree("footer", [para(5)])])])


def brute_texts(trees, vote):
    """Texts of one host's pages, by recursion over the trees."""
    scored, sums = [], {}
    for tree in trees:
        whole = sum(len(t) for t, link in tree.texts() if not link)
        own = {}

        def score(node, path, inside, own=own, whole=whole):
            if node.tag in ("p", "h1", "li", "a"):
                return
            path, inside = (*path, (node.tag, re.sub("[0-9]+", "N", node.label))), inside or node.tag == "article"
            size, plain = sum(len(t) for t, _ in node.texts()), sum(len(t) for t, link in node.texts() if not link)
            if size:
                linked = 1000 * (size - plain) // size
                against = node.tag in ("nav", "footer") or node.ident == "comments"
                menu = linked > 500 and not inside and node.tag not in ("ul", "html", "body")
                own[id(node)] = (path, 1000 * plain // whole - linked * menu - 2000 * against + 500 * (node.tag == "article"))
                kept, gone, total = sums.get(path, (0, 0, 0))
                bad = own[id(node)][1] < 0
                sums[path] = (kept + (not bad), gone + bad, total + own[id(node)][1])
            for x in node.inside:
                score(x, path, inside)

        score(tree, (), False)
        scored.append(own)

    def walk(node, own, place, out):
        path, value = own.get(id(node), (None, 0))
        kept, gone, total = sums.get(path, (0, 0, 0))
        if (total if vote and kept and gone else value) < 0 and node.tag not in ("html", "body"):
            return
        if node.tag in ("p", "h1", "li"):
            if place != "aside":
                out.append(" ".join(t for t, _ in node.texts()))
            return
        place = "article" if node.tag == "article" else place if place or node.tag in ("html", "body") else "aside"
        for x in node.inside:
            walk(x, own, place, out)

    texts = []
    for tree, own in zip(trees, scored, strict=True):
        out = []
        walk(tree, own, "", out)
        texts.append("\n\n".join(out))
    return texts


def test_html_matches_a_plain_walk_with_and_without_votes(spark):
    rng = np.random.default_rng(8)
    hosts = [[made_page(rng) for _ in range(9)] for _ in range(6)]
    rows = [(100 * h + k, f"http://h{h}.net/{k}", tree.html()) for h, trees in enumerate(hosts) for k, tree in enumerate(trees)]
    found = {}
    for vote in (True, False):
        found[vote] = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, rows), vote=vote).collect()}
        want = {100 * h + k: text for h, trees in enumerate(hosts) for k, text in enumerate(brute_texts(trees, vote))}
        assert found[vote] == want
    changed = [k for k in want if found[True][k] != found[False][k]]
    assert len(changed) > 10  # the votes matter: a host's pages go by one rule
    for h, trees in enumerate(hosts):
        boxes = {trees[k].inside[0].inside[3].inside[2].texts()[0][0] in found[True][100 * h + k] for k in range(9)}
        assert len(boxes) == 1


def test_html_of_deep_and_broken_pages_is_linear(spark):
    deep = "".join(f"<div class=c{k}>t{k} <b>" for k in range(20_000))
    lists = "<ul>" + "".join(f"<li><span>i{k}" for k in range(20_000))
    ends = "<div>" * 5000 + "x" + "</p></b></span>" * 20_000
    rows = [(1, "http://d/1", deep), (2, "http://d/2", lists), (3, "http://d/3", ends)]
    began = time.perf_counter()
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, rows)).collect()}
    assert time.perf_counter() - began < 30
    assert got[1].split()[::5000] == ["t0", "t5000", "t10000", "t15000"] and got[2].count("i") == 20_000 and got[3] == "x"
