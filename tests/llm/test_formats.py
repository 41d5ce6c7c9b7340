"""Packing, chat formatting, HTML text and licence scans."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.llm import chat, htmltext, licenses, packing
from gneiss.llm.common import table
from gneiss.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_hold_every_id_once(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "x <|endoftext|> y"), (9004, "漢字 ½ \x1c z " * 900), (9004, "again"), (None, "no id")]
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(3), tokenizer_path()).collect()
    of = {}
    for r in out:
        of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(of[doc, len(ids)], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert total <= 2048 and len(pieces) <= packing.MAX_SEGMENTS and total & (total - 1) == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_both_encoders_agree(value):
    if not hasattr(test_both_encoders_agree, "pair"):
        from tokenizers import Tokenizer

        test_both_encoders_agree.pair = packing.load_encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    fast, slow = test_both_encoders_agree.pair
    assert fast(value) == slow.encode(value, add_special_tokens=False).ids


@pytest.mark.parametrize("value", [" " * 1_000_000, "a\n" + "\n" * 1_000_000 + "b", "x" * 1_000_000, "7" * 1_000_000, "word " * 200_000, "a" + " " * 10_001 + "b", "!" * 300_000], ids=["spaces", "lines", "letters", "digits", "words", "edge", "marks"])
def test_long_runs_are_encoded(spark, tokenizer, value):
    ids = [*tokenizer.encode(value, add_special_tokens=False).ids, 1]
    assert packing.load_encoder(tokenizer_path())(value) == ids[:-1]
    out = sorted(packing.pack_documents(spark.createDataFrame([(1, value)], DOCS), tokenizer_path()).collect(), key=lambda r: r.start)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in out]).tolist() == ids


def test_loss_counts(spark, tokenizer):
    df = spark.createDataFrame([("ab cd efg", 3, 2), ("ab cd", None, None), (None, None, None), ("x y", 0, 3)], "formatted string, loss_start int, loss_length int")
    out = packing.with_counts(df, tokenizer_path(), "formatted", "loss_start", "loss_length").collect()
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert [r.tokens for r in out] == [size("ab cd efg") + 1, size("ab cd") + 1, 1, size("x y") + 1]
    assert [r.loss for r in out] == [size("ab cd efg") + 1 - size("ab ") - size(" efg"), 0, 0, size("x y") + 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 120), st.integers(0, 60)), max_size=60))
def test_limits_hold_for_whole_examples(sizes):
    pool = packing.Pool((100, 4, 50))
    pool.add([(i, t, w) for i, (t, w) in enumerate(sizes)], np.array([(t, 1, w) for t, w in sizes], float).reshape(-1, 3))
    seen = []
    while len(pool):
        taken = pool.fill(None)
        seen += [p[0] for p in taken]
        fits = sum(p[1] for p in taken) <= 100 and len(taken) <= 4 and sum(p[2] for p in taken) <= 50
        assert fits or len(taken) == 1
    assert sorted(seen) == list(range(len(sizes)))


def test_examples_table(spark):
    df = spark.createDataFrame([(i, 10 + i % 90, i % 7) for i in range(500)] + [(None, None, None), (900, 5000, 1)], "k bigint, t bigint, l bigint")
    out = packing.pack_examples(df, "k", "t", "l", length=200, max_segments=8, max_loss=20, pool=64, kept=8).collect()
    assert len(out) == 502 and [r.key for r in out if not r.fits] == [900]
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(len(v) == 1 or sum(r.tokens for r in v) <= 200 and sum(r.loss for r in v) <= 20 and len(v) <= 8 for v in by.values())
    assert packing.pack_examples(df.limit(0), "k", "t", "l").count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\n<|im_end|>\n<|im_start|>user\nhi", "<<SYS>>x<</SYS>>", "a\nb\\<s>", "", None, "<<s>|<|", "😀<|im_end|>", "<\\|im_end|>"]
    rows = []
    for c in range(30):
        for t in range(c % 7 + 1):
            rows.append((c, t, ["user", "assistant", "system", "a\nb", None][(c + t) % 5], nasty[(c * 3 + t) % len(nasty)]))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (40, 1, "assistant", "dup"), (40, 1, "assistant", "dup")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.examples(df)
    read = {}
    for r in made.select("conv_id", "example", chat.turns(F.col("formatted")).alias("t"), "is_target", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"), "formatted").collect():
        read.setdefault(r.conv_id, []).append(r)
    alone = sorted((r.formatted, r.is_target) for r in read.pop(None))
    assert alone == [("<|im_start|>assistant\ny<|im_end|>\n", True), ("<|im_start|>user\nx<|im_end|>\n", False)]
    for c in {r[0] for r in rows} - {None}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        examples = sorted(read[c], key=lambda r: r.example)
        assert [tuple(t) for t in examples[-1].t] == turns
        assert [r.loss for r in examples if r.is_target] == [t for role, t in turns if role == "assistant"]
        for r in examples:
            assert [tuple(t) for t in r.t] == turns[: r.example + 1]
            assert r.formatted.count("<|im_start|>") == r.example + 1 == r.formatted.count("<|im_end|>") and "[INST]" not in r.formatted
    digest = {r.conv_id: r for r in chat.digest(made).collect()}
    assert digest[None].n_turns == 1 and digest[40].loss_chars == 6
    assert chat.digest(made).where("conv_id is null").count() == 2
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>One</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many. Really.</p></div><div id="sidebar"><p>Side text, long enough to tempt. Yes.</p></div>
%s<form><p>Write, to us. Now.</p><input></form><footer>&copy; foot</footer><script>var a="<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize(
    "body,expected",
    [
        ("<article><h1>Ti &amp; tle</h1><p>Para  one,\n with <b>bold</b>text. <a href=x>Link</a>.</p><p>B.</p><div class='comments'><p>Reader says. Things, here.</p></div></article>", "Ti & tle\nPara one, with boldtext. Link.\nB."),
        ("<div class=content><h2>Head</h2><p>First para, long enough. Good.<p>Second; fine.<ul><li>item<li>other</ul></div>", "Head\nFirst para, long enough. Good.\nSecond; fine.\nitem\nother"),
        ("<main><p>a&nbsp;b &lt;tag&gt; &#x41;, yes.</p><aside><p>Aside, note. Here.</p></aside><p><b>open<br><p>next, one.</p></main>", "a b <tag> A, yes.\nopen\nnext, one."),
    ],
)
def test_main_text(body, expected):
    assert htmltext.main_text(PAGE % body) == expected


@pytest.mark.parametrize("name", ["ad", "ad-slot", "adslot 2", "topAd", "reader-comments", "commentList", "cookiebar", "siteFooter", "sidebar-left", "notice", "main-nav", "share-buttons"])
def test_noise_names(name):
    page = f"<body><div class='post has-sidebar'><p>Text, of the article. Long enough.</p><div class='{name}'><p>Noise, of some kind. Also long.</p></div></div></body>"
    assert htmltext.main_text(page) == "Text, of the article. Long enough."


@pytest.mark.parametrize("name", ["post-header", "lead", "additional", "addressing", "chapter", "document"])
def test_content_names(name):
    page = f"<body><div class='post'><div class='{name}'><h1>Head, line.</h1></div><p>Text, of the article. Long enough.</p></div></body>"
    assert htmltext.main_text(page) == "Head, line.\nText, of the article. Long enough."


@pytest.mark.parametrize(
    "tag,name",
    [("article", "post-12 post type-post hentry category-news tag-politics"), ("article", "social-history article"), ("main", "layout-sidebar main")]
    + [("div", n) for n in ("content-sidebar-wrap", "sidebar-right container", "layout-sidebar main", "elementor-widget-theme-post-content", "post tag-politics")],
)
def test_names_alone_lose_no_article(tag, name):
    text = "<h1>Head, line.</h1><p>Text, of the article. Long enough.</p><div class='reader-comments'><p>Noise, it is.</p></div>"
    page = f"<body><div class='ad'><p>Buy, now.</p></div><{tag} class='{name}'>{text}</{tag}></body>"
    assert htmltext.main_text(page) == "Head, line.\nText, of the article. Long enough."


def test_names_of_posts_and_of_long_comments():
    posts = "".join(f"<div class='post tag-news'><p>Text number {k}, of a post. Long enough.</p></div>" for k in range(3))
    assert htmltext.main_text(f"<body>{posts}</body>").count("Text number") == 3
    page = f"<body><article><p>Text, of the article. Long enough.</p></article><div id='comments'>{'<p>Noise, of some kind. Also long.</p>' * 9}</div></body>"
    assert htmltext.main_text(page) == "Text, of the article. Long enough."


@pytest.mark.parametrize(
    "body,expected",
    [
        ("<div><h1>A title, of some length</h1><section><p>The intro, of one line.</p></section><div><p>First para, long enough. Good.</p><p>Second; fine, and longer.</p></div></div>", "A title, of some length\nThe intro, of one line.\nFirst para, long enough. Good.\nSecond; fine, and longer."),
        ("<div class=lead><p>What leads, in a line.</p></div><article><p>First para, long enough. Good.</p><p>Second; fine.</p></article>", "What leads, in a line.\nFirst para, long enough. Good.\nSecond; fine."),
        ("<article><p>First para, long enough. Good.</p></article><article><div><p>Other article, as long. Good.</p></div></article>", "First para, long enough. Good.\nOther article, as long. Good."),
        ("<div><p>First para, long enough. Good.</p><p>Second; fine.</p><ul><li><a href=x>A reference</a></ul></div>", "First para, long enough. Good.\nSecond; fine.\nA reference"),
    ],
)
def test_all_content_paths_select(body, expected):
    assert htmltext.main_text(PAGE % body) == expected


def test_main_text_of_odd_pages(spark):
    assert htmltext.main_text("") == "" and htmltext.main_text("<html><nav>x</nav>") == "" and htmltext.main_text("<<<>") == "<<<>"
    assert htmltext.main_text("just text") == "just text" and htmltext.main_text("<!-- never closed <p>x</p>") == ""
    assert htmltext.main_text("<p>" * 3000 + "deep, text.") == "deep, text."
    df = spark.createDataFrame([(1, None, "u", 5), (2, "<p>x, y.</p>", None, 6)], "page_id bigint, html string, text string, n int")
    out = {r.page_id: (r.text, r.n_chars, r.n) for r in htmltext.with_main_text(df).collect()}
    assert out == {1: ("", 0, 5), 2: ("x, y.", 5, 6)}
    assert htmltext.with_main_text(df.limit(0)).count() == 0


PARAS = "".join(f"<p>Paragraph {k}, of some length. It says, more or less, the same; again.</p>" for k in range(4))
PARAS_TEXT = "\n".join(f"Paragraph {k}, of some length. It says, more or less, the same; again." for k in range(4))


@pytest.mark.parametrize("opening", ["article class='post hentry category-news tag-python'", "article id='search-algorithms'", "article class='short-form'", "article id='notice-of-meeting'", "article class='story shared-story'", "div id='search-algorithms'", "div id='notice-of-meeting'", "div class='story shared-story'"])
def test_no_word_of_a_name_drops_the_article(opening):
    page = f"<body><div class=menu><a href=a>One</a></div><{opening}><h1>Title</h1>{PARAS}</{opening.split()[0]}><div class='user-reviews'><p>I like it, a lot.</p></div></body>"
    assert htmltext.main_text(page) == "Title\n" + PARAS_TEXT


@pytest.mark.parametrize("head", ["<div class='content-header'><h1>Title</h1></div>", "<div class='section-header'><h1>Title</h1></div>", "<header><h1>Title</h1><div>by one</div></header>"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_titles_stay(tag, head):
    links = "<ul><li><a href=x>A reference</a></li><li><a href=y>Another reference</a></li></ul>"
    page = f"<body><header><h2>Site</h2></header><{tag}>{head}{PARAS}{links}</{tag}><div class='author-bio'><p>Writes, a lot.</p></div></body>"
    assert htmltext.main_text(page) == f"Title\n{PARAS_TEXT}\nA reference\nAnother reference"


@pytest.mark.parametrize("side", ["<p><a href=a>One story to read, now</a></p><p><a href=b>Another story, too</a></p>", "<p>Short</p>"])
def test_sides_without_a_name_go(side):
    page = f"<html><body><div><div><p>Top</p></div><h1>Title</h1><div>{PARAS * 3}</div><div>{side}</div></div></body></html>"
    assert htmltext.main_text(page) == "Title\n" + "\n".join([PARAS_TEXT] * 3)


def test_a_template_of_its_own(spark):
    """Pages of another make than the tables': nested parts, names of every kind, odd markup."""
    import random
    import re

    rng = random.Random(17)
    words = [f"w{i}" for i in range(400)]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    for k in range(60):
        paras = [" ".join(sentence(rng.randint(6, 18)).capitalize() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 12))]
        title = sentence(5)[:-1]
        noise = [f"<div class='{rng.choice(['sidebar', 'c-ad', 'related-posts', 'newsletter-box', 'social-links', 'cookie-banner'])}'><p>{sentence(12)}</p></div>" for _ in range(3)]
        comments = "<section id='comments'>" + "".join(f"<div class='comment-body'><p>{sentence(15)}</p></div>" for _ in range(rng.randint(0, 40))) + "</section>"
        wrap = rng.choice(["<article class='%s'>{}</article>", "<main class='%s'>{}</main>", "<div class='entry %s'>{}</div>"]) % rng.choice(["post tag-x", "single", "layout-sidebar", "social-history"])
        body = f"<h1>{title}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p class=x>{}", "<div><p>{}</p></div>"]).format(re.sub("w7 ", "<em>w7</em> ", p)) for p in paras)
        page = f"<html><head><title>{title}</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav>{noise[0]}<div class=page>{noise[1]}{wrap.format(body)}{noise[2]}</div>{comments}<footer><p>{sentence(9)}</p></footer></body></html>"
        assert htmltext.main_text(page) == "\n".join([title, *paras]), page


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 100_000, '<a "' * 100_000, '<a =">" ' * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<li>" + "<div>" * 50_000 + "<ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<p><li>" + "<b>" * 50_000 + "<div>y</div>" * 50_000, "<div class=sidebar>x" * 50_000, "<![CDATA[" * 100_000 + ">", "<" * 200_000 + ">"],
    ids=["open", "quotes", "quoted ends", "ends", "lists", "inline", "named", "cdata", "marks"],
)
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.monotonic()
    htmltext.main_text(page)
    assert time.monotonic() - start < 15


def test_pages_against_their_markup(spark):
    """Main text of real pages equals what stands between the article's tags."""
    import re
    from html import unescape

    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        inner = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>(?=<p)", inner))
        assert htmltext.main_text(r.html) == "\n".join(b for b in blocks if b)


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND. See the License for the specific language governing permissions and\nlimitations under the License.'


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Foo bar.\nLicensed under CC BY-NC 4.0.\nMore.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("no mark before it\nReleased under the MIT License.", ["MIT"]),
        (APACHE, ["Apache-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\ncode", ["MIT OR Apache-2.0"]),
        ("Released under the MIT License. Licensed under CC BY 4.0. Released under the MIT licence.", ["MIT", "CC-BY-4.0"]),
        ("Use is subject to some other license.", ["UNKNOWN"]),
        ("He has a driving license, she a fishing licence.", []),
        ("This dataset is available under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
        ("Distributed under the terms of the GNU LGPL, version 2.1.", ["LGPL-2.1"]),
        ("Licensed under the EUPL-1.2, and under the ISC license.", ["EUPL-1.2"]),
        ("Released under the GNU General Public License, version 2 or later.", ["GPL-2.0-or-later"]),
        ("Nothing of the kind. The end", []),
        ("", []),
    ],
)
def test_license_scan(text, expected):
    assert licenses.scan(text)[0] == expected


GNU = """This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License
as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this {what}{end}"""
WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
SEE = ". If not, see <https://www.gnu.org/licenses/>."
AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
BSD = """Copyright (c) 2020, The Owner. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


@pytest.mark.parametrize(
    "text,expected",
    [
        (GNU.format(what="program", kind="", a=";", b=";", version="2", end=WRITE), "GPL-2.0-or-later"),
        (GNU.format(what="program", kind="", a=":", b=",", version="3", end=SEE), "GPL-3.0-or-later"),
        (GNU.format(what="program", kind="", a=";", b=";", version="3", end=WRITE), "GPL-3.0-or-later"),
        (GNU.format(what="library", kind="Lesser ", a=";", b=";", version="2.1", end=WRITE), "LGPL-2.1-or-later"),
        (GNU.format(what="program", kind="Affero ", a=":", b=",", version="3", end=SEE), "AGPL-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
        (BSD.format(third=THIRD), "BSD-3-Clause"),
        (BSD.format(third=""), "BSD-2-Clause"),
        ("This is free and unencumbered software released into the public domain." + AS_IS, "Unlicense"),
        ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + AS_IS, "MIT"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + AS_IS, "0BSD"),
        ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", "Zlib"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use it.", "BSL-1.0"),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1.", "MPL-1.1"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.", "EPL-2.0"),
        (GNU.format(what="library", kind="Lesser ", a=":", b=",", version="3", end=SEE), "LGPL-3.0-or-later"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ],
)
def test_standard_notices(text, expected):
    assert licenses.scan(text)[0] == [expected]
    assert licenses.scan("Intro. " + text.replace("\n", "\n  ") + "\nMore text.")[0] == [expected]


def brute_identifiers(sentence):
    """All forms at all places by regular expressions; the first and longest take what they cover."""
    import re

    forms = [(form, name) for known in (licenses.SENTENCES, licenses.named_sentences()) for name, some in known.items() for form in some]
    found = []
    for form, name in forms:
        if all(run in sentence for run in form.split(" * ")):
            found += [(m.start(), -m.end(), name) for m in re.finditer(r"(?<![^ ])" + form.replace(" * ", r" (?:\S+ ){0,12}?") + r"(?![^ ])", sentence)]
    out, upto = [], -1
    for start, end, name in sorted(found):
        if start >= upto:
            out.append(name)
            upto = -end
    return out


def test_lookup_equals_a_search_for_every_form():
    import random

    rng = random.Random(5)
    forms = [f for known in (licenses.SENTENCES, licenses.named_sentences()) for some in known.values() for f in some]
    few = [f for some in licenses.SENTENCES.values() for f in some]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 4)):
            form = rng.choice(few if rng.random() < 0.5 else forms).replace("*", " ".join("x" * rng.randint(0, 14))).split()
            words += ["and"] * rng.randint(0, 2) + form[: rng.choice([len(form), len(form) - 1])]
        sentence = " ".join(words)
        assert licenses.identifiers(sentence) == brute_identifiers(sentence), sentence


def test_hostile_texts_are_scanned_in_linear_time():
    import time

    start = time.monotonic()
    for text in ("license " * 100_000, "." * 1_000_000 + "license", "v. 2" * 200_000 + " license", "under the terms of the " * 50_000, "gnu " * 200_000, "x" * 2_000_000 + " licensed under the mit license"):
        licenses.scan(text)
    assert time.monotonic() - start < 20


def test_license_rules_in_order():
    assert licenses.by_rules(["mit-grant", "mit-notice", "as-is-provided", "apache-2"]) == [(0, "MIT"), (3, "Apache-2.0")]
    assert licenses.by_rules(["as-is-provided", "mit-grant"]) == [(0, "UNKNOWN"), (1, "UNKNOWN")]
    for forms in (*licenses.SENTENCES.values(), *licenses.named_sentences().values()):
        assert all(licenses.triggered(f) and licenses.normal(f) == f.replace(" * ", " ") for f in forms)
    text = "Intro. " + APACHE
    assert [text[a:b].strip()[:8] for _, a, b in licenses.scan(text)[1]][0] == "Licensed"


def test_license_table(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x"), (2, None, "y"), (2, "y " * 50_000, None)], DOCS + ", licenses string")
    out = licenses.with_licenses(df).collect()
    assert [r.licenses for r in out] == [["MIT"], [], []] and out[0].license_spans[0].sentence_id == "mit-named"
    assert licenses.with_licenses(df.limit(0)).count() == 0


PARAGRAPHS = ["The first paragraph tells, at some length, what happened; it has commas, and stops.", "A second one follows, with more of the same, long enough to count as text.", "The third ends it all, finally, with a few words more, and a stop."]
READERS = "".join(f"<p>{x}</p>" for x in ("I liked this a lot, thanks for writing it up, really.", "Well, I did not, and I will say so, at length, because I can.", "Me too, as they say, and more words."))


@pytest.mark.parametrize(
    "within,after",
    [
        ("<div class='werbung'><p>Kaufen Sie jetzt, es ist das Beste, und es wird Ihnen gefallen.</p></div>", ""),
        ("<div class='anzeige'><p>Kaufen Sie jetzt, es ist das Beste, und es wird Ihnen gefallen.</p></div>", ""),
        ("<div class='publicite'><p>Achetez maintenant, c'est bien, vous allez aimer.</p></div>", ""),
        ("", f"<div id='kommentare'>{READERS}</div>"),
        ("", f"<div class='guestbook'>{READERS}</div>"),
        ("", f"<section class='responses'>{READERS}</section>"),
        ("", f"<div>{READERS}</div>"),
        ("", f"<div class='x7q'>{READERS}</div>"),
        ("", "<div><p>Also read our other piece. Sign up now!</p></div>"),
    ],
)
def test_nothing_outside_of_an_article_and_no_adverts_inside(within, after):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<html><body><nav>Home About</nav><article><h1>Title here</h1>{body}{within}</article>{after}<footer>c</footer></body></html>"
    assert htmltext.main_text(page) == "\n".join(["Title here", *PARAGRAPHS])


@pytest.mark.parametrize("name,kept", [("lead", True), ("article-intro", True), ("vorspann", True), ("x7q", False), ("lead-form", False), ("intro comments", False)])
def test_a_named_lead_before_an_article_belongs_to_it(name, kept):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    lead = "What it is about, in a line, before it begins."
    for at in ("before", "after"):
        block = f"<div class='{name}'><p>{lead}</p></div>"
        page = f"<html><body>{block * (at == 'before')}<article>{body}</article>{block * (at == 'after')}</body></html>"
        assert htmltext.main_text(page) == "\n".join([lead] * (kept and at == "before") + PARAGRAPHS)


def test_a_small_article_beside_the_text_does_not_hide_it():
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    found = htmltext.main_text(f"<html><body><article><p>Teaser words.</p></article><div class='c'>{body}</div></body></html>")
    assert all(p in found for p in PARAGRAPHS)
