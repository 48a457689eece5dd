"""Patterns read tags as HTMLParser does, and clips need no window over all nodes."""

import os
import random
from unittest.mock import patch

from quire.sources import daisy

BOOKS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "books")
BITS = """<smil>|</smil>|<head>|</head>|<body>|</body>|<BODY>|<seq>|<seq id="a" dur="3s">|</seq>|<par>|<par id='p' endsync="last">|</par>|<par/>|<seq/>|<text src="c#1" id="t"/>|<text src="x">
<audio src="a.mp3" clip-begin="npt=1s" clip-end="npt=2s"/>|<audio SRC="a.mp3" clipbegin="1" clipEnd="2"></audio>|<ref title="a &amp; b" src="s"/>|<ref title="T" src="1.smil"/>|<meta name="n" content="v"/>|<meta name="n"/>
<!-- c <par> -->|<?xml version="1.0"?>|<!DOCTYPE smil PUBLIC "a" "b">|text & more|a > b|<title>x</title>|<seq a=1>|<par a>|</par >|< par>|<h1 class="section" id="h1"><a href="1.smil#t"> P &amp; q &eacute; </a></h1>|<h2><a href="x">|</a>|</h2>
<span class="page-normal" id="p"><a href="1#q">3</a></span>|</span>|<h3/>|<a/>|<|"|<par|<style>|<br/>|<audio src="a" src="b"/>""".replace("\n", "|").split("|")


def test_patterns_read_tags_as_the_parser_does():
    rng, plain = random.Random(5), 0
    simple = [b for b in BITS if daisy.plain_tags(b) is not None]
    for n in range(6000):
        some = BITS if n % 3 else simple
        markup = "<smil><body>" * (n % 2) + "".join(rng.choice(some) for _ in range(rng.randint(1, 30)))
        a, b = daisy.parse_smil(markup), daisy.parse_ncc(markup)
        plain += daisy.plain_tags(markup) is not None
        with patch.object(daisy, "plain_tags", lambda _: None):
            c, d = daisy.parse_smil(markup), daisy.parse_ncc(markup)
        assert (a.meta, a.refs, a.rows, b.meta, b.nav) == (c.meta, c.refs, c.rows, d.meta, d.nav), markup
        last, out = None, -1  # the par of each audio by the rule: the last before it, if no node since is as high
        for r in a.rows:
            if r[3] == "par":
                last = r
            elif last and r[2] <= last[2]:
                out = r[0]
            assert r[10] == (last[0] if r[3] == "audio" and last and out < last[0] else None), markup
    assert 1000 < plain < 5000


def test_clips_are_placed_where_files_are_parsed(spark):
    clips = daisy.load(spark, BOOKS)["clips"]
    assert "Window" not in clips._jdf.queryExecution().optimizedPlan().toString()
    assert clips.count()
