"""Labelled pages for the block tagger: leaf blocks that belong to the main text carry ``data-y``.

Pages are put together from fragments written by hand: a container of the article, what it holds, and what stands before,
inside and after it. Every third fragment of a list is kept apart for tests of layouts that the tagger has not seen; the
words are filler from a fixed generator.
"""

from __future__ import annotations

import re

import numpy as np

#: ``@n`` stands for n filler words ending in a full stop, ``#n`` for n filler words without marks, ``Y`` for the label.
#: A container's ``~`` is where the article goes.
CONTAINERS = (
    "<article>~</article>", '<main><article class="post">~</article></main>', '<div id="content">~</div>', '<div class="post"><div class="entry">~</div></div>', '<article class="story">~</article>',
    '<div class="main">~</div>', "<main>~</main>", '<div class="post-content">~</div>', '<section class="article"><div class="text">~</div></section>', "<div>~</div>", '<div class="wrapper"><div class="row"><div class="col">~</div></div></div>',
    '<div class="article-body">~</div>', "<article><section>~</section></article>", '<div class="container"><article id="post-7">~</article></div>', "~", '<table><tr><td>~</td></tr></table>', '<div role="main">~</div>', '<div class="entry-content">~</div>',
    '<div itemprop="articleBody">~</div>', '<div class="page"><div class="story-body">~</div></div>', '<div class="blog"><div class="blog-post">~</div></div>', '<div id="main"><div id="primary">~</div></div>', '<article role="article"><div>~</div></article>', '<div class="c1"><div class="c2">~</div></div>',
)
BODIES = (
    "<h1 Y>#7</h1><p Y>@40</p><p Y>@3</p>^<p Y>@25</p>", "<h1 Y>#9</h1><p Y><b>@12</b><br><p Y>@30</p>^<p Y>@2</p><p Y>@60</p>", "<header><h1 Y>#8</h1></header><p Y>@45</p><blockquote><p Y>@15</p></blockquote>^<p Y>@33</p>",
    "<h2 Y>#7</h2><p Y>@38</p>^<p Y>@41</p><pre Y>#9</pre>", "<h1 Y>#5</h1><p Y>@1</p><p Y>@2</p>^<p Y>@1</p><table><tr><td Y>#2</td><td Y>#1</td></tr></table><figure><figcaption Y>@7</figcaption></figure><p Y>@50</p>", "<h1 Y>#6</h1><p Y>@35</p><h2 Y>#4</h2><p Y>@28</p>^<ul><li Y>@8</li><li Y>@11</li></ul>",
    "<h1 Y>#6</h1><div Y>@35</div><div Y>@12</div>^<div Y>@28</div>", "<div><h1 Y>#5</h1></div><div Y>@18</div>^<div Y>@10</div><ul><li Y>@9</li></ul>", "<h1 Y>#4</h1><p Y>@2</p>^", "<p Y>@5</p><p Y>@15</p>^<p Y>@24</p>", "<h1 Y>#5</h1><div><span Y>@30</span></div>^<div><div Y>@33</div><div Y>@18</div></div>", "<h1 Y>#8</h1><p Y>@20 <a href=/x>#2</a> @9</p>^<ol><li Y>@9</li><li Y>@6</li></ol><p Y>@31</p>",
    "<section><h2 Y>#3</h2><p Y>@20</p></section>^<section><h2 Y>#3</h2><p Y>@24</p></section>", "<p Y>#3</p>^", "<h3 Y>#4</h3><p Y>@9</p>^<p Y>@33</p>", "<h1 Y>#2</h1><p Y>#1</p>^<p Y>#2</p>", '<div class="entry-header"><h1 Y>#6</h1></div><p Y>@26</p>^<p Y>@37</p>', '<div class="post-header"><h2 Y>#5</h2></div><div class="post-text"><p Y>@30</p></div>^', "<div><h1 Y>#6</h1></div><div Y>@30<br>@20</div>^<div Y>@26</div>", "<h3 Y>#5</h3><dl><dt Y>#2</dt><dd Y>@12</dd></dl>^<p Y>@44</p>",
)
BEFORE = (
    '<header><a href="/">#2</a></header>', '<nav><ul><li><a href="/a">#1</a></li><li><a href="/b">#1</a></li><li><a href="/c">#1</a></li></ul></nav>', '<div class="ad">@9</div>', '<div class="cookie-notice"><p>@12</p><button>#1</button></div>',
    '<div id="header"><a href="/">#2</a></div><div id="menu"><ul><li><a href="/a">#2</a></li><li><a href="/b">#2</a></li></ul></div>', '<div class="top"><form action="/s"><input name="q"><label>#1</label></form></div>', '<header><h1>#2</h1><nav><a href="/a">#1</a> <a href="/b">#1</a></nav></header>',
    '<div class="banner ad"><a href="/buy">#4</a></div>', '<nav class="breadcrumb"><a href="/">#1</a> <a href="/k">#1</a></nav>', '<div class="notice"><p>@10</p></div>', '<table class="nav"><tr><td><a href="/a">#1</a></td><td><a href="/b">#1</a></td></tr></table>', '<section class="hero"><a href="/go">#2</a></section>',
    '<div role="navigation"><a href="/a">#1</a> <a href="/b">#2</a> <a href="/c">#1</a></div>', '<div id="consent" role="dialog"><p>@18</p><p>@7</p></div>', '<div class="gdpr-banner"><h3>#2</h3>@16</div>', '<div role="banner"><h2>#3</h2><p>#3</p></div>', '<div class="sponsored"><p>@13</p></div>', '<ul class="menu main-menu"><li><a href="/a">#1</a></li><li>#1</li></ul>',
    '<div class="cookie-consent"><div>@14</div></div>', '<div id="sidebar-left"><h3>#2</h3><p>@8</p></div>', '<div class="alert alert-info"><h2>#3</h2>@11</div>', '<div class="topbar navbar"><span>#2</span> <a href="/l">#1</a></div>', '<div class="site-header"><h1>#3</h1><p>#4</p></div>', '<div class="announcement">@10</div>',
    '<div class="site-notice warning"><p>@9</p></div>', '<div role="search"><form><label>#2</label></form></div>', '<div class="privacy-popup modal"><h2>#2</h2><p>@15</p></div>', '<div class="advertisement"><p>@8</p></div>', '<div class="toolbar"><a href="/1">#1</a> | <a href="/2">#1</a></div>', '<div class="masthead"><h2>#2</h2></div>',
)
INSIDE = (
    "", '<div class="ad">@12</div>', "", '<aside><p>@10</p><a href="/x">#3</a></aside>', '<div class="advert"><p>@8</p></div>', "", '<div class="newsletter-signup"><p>@7</p><form><label>#2</label></form></div>', "<form><p>@9</p><label>#2</label></form>", '<div class="promo-box"><p>@11</p></div>',
    '<div class="sponsored-content"><h4>#3</h4><p>@14</p></div>', '<div class="related"><h3>#2</h3><ul><li><a href="/1">#5</a></li></ul></div>', '<div class="share social"><a href="/f">#1</a> <a href="/t">#1</a></div>', '<aside class="pullout"><div>@12</div></aside>', '<div class="promo banner">@9</div>', '<div class="ads ad-slot"><span>@6</span></div>',
    '<div class="subscribe"><h2>#3</h2><p>@10</p></div>', '<div class="ad-container"><div class="ad-label">#1</div><p>@13</p></div>', '<div role="complementary"><p>@15</p></div>',
)
AFTER = (
    "<footer>&copy; #2 &middot; @5</footer>", '<div id="footer"><p>&copy; #3</p></div>', '<section class="comments"><h2>#1</h2><div class="comment"><p>@14</p></div><div class="comment"><p>@9</p></div><form><label>#1</label><textarea></textarea></form></section>', '<footer><ul><li><a href="/t">#1</a></li></ul></footer>',
    '<div class="related"><h3>#2</h3><ul><li><a href="/1">#5</a></li><li><a href="/2">#6</a></li></ul></div>', '<div id="comments"><p>@12</p><p>@20</p></div>', '<aside class="sidebar"><p>@11</p><p>@13</p></aside>', '<div class="footer"><a href="/p">#1</a> <a href="/q">#1</a></div>', '<div id="sidebar"><h3>#2</h3><ul><li><a href="/x">#4</a></li><li><a href="/y">#5</a></li></ul></div>',
    '<ol class="commentlist"><li><div class="comment-body"><p>@22</p><p>@7</p></div></li><li><div class="comment-body"><p>@16</p></div></li></ol>', '<div id="responses"><h3>#2</h3><p>@19</p><p>@25</p></div>', '<div role="contentinfo"><p>@8</p></div>', '<div class="widget-area"><div class="widget"><h4>#2</h4><p>@9</p></div></div>',
    '<div id="disqus_thread"><div>@17</div></div>', '<section id="reader-comments"><article class="comment"><p>@21</p></article><article class="comment"><p>@10</p></article></section>', '<div class="pagination"><a href="/2">#1</a> <a href="/3">#1</a></div>', '<div class="replies"><ul><li class="reply"><p>@15</p></li><li class="reply"><p>@18</p></li></ul></div>',
    '<div class="sponsored"><p>@12</p><p>@16</p></div>', '<div class="comments-area"><div class="comment-content">@24</div></div>', '<div class="site-footer"><p>@6</p><p>&copy; #2</p></div>', '<div role="complementary"><h3>#2</h3><p>@12</p></div>', '<div class="discussion"><div class="message"><p>@20</p></div></div>',
    '<div class="recommended"><h3>#2</h3><p><a href="/1">#6</a></p><p><a href="/2">#7</a></p></div>', '<div class="newsletter"><h3>#3</h3><p>@11</p></div>', '<div class="copyright"><p>@7</p></div>', '<div class="feedback user-comments"><p>@13</p></div>', '<div class="tags"><a href="/a">#1</a> <a href="/b">#1</a></div>',
    '<div class="bottom legal"><p>@9</p></div>', '<div class="popular most-read"><ol><li><a href="/1">#5</a></li><li><a href="/2">#5</a></li></ol></div>', "<form><fieldset><legend>#2</legend><p>@8</p></fieldset></form>",
)


def layouts(count: int, seed: int, part: str = "all") -> list[str]:
    """``count`` layouts from all fragments, or only from those for ``"training"`` or those ``"held out"``."""
    rng = np.random.default_rng(seed)
    choose = {"all": lambda k: True, "training": lambda k: k % 3 != 2, "held out": lambda k: k % 3 == 2}[part]
    own = [[x for k, x in enumerate(fragments) if choose(k)] for fragments in (CONTAINERS, BODIES, BEFORE, INSIDE, AFTER)]
    out = []
    for k in range(count):
        container, body = own[0][k % len(own[0])], own[1][int(rng.integers(len(own[1])))]
        before = "".join(own[2][int(i)] for i in rng.permutation(len(own[2]))[: rng.integers(0, 4)])
        after = "".join(own[4][int(i)] for i in rng.permutation(len(own[4]))[: rng.integers(0, 4)])
        out.append(before + container.replace("~", body.replace("^", own[3][int(rng.integers(len(own[3])))])) + after)
    return out


def pages(count: int = 480, seed: int = 11, part: str = "all") -> list[str]:
    """Whole pages of ``layouts`` with filler."""
    rng = np.random.default_rng(seed)
    syllables = ["an", "the", "er", "ou", "tion", "st", "in", "le", "ch", "re", "ver", "os", "de", "qui"]

    def fill(m: re.Match) -> str:
        made = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(int(m[2]))]
        return " ".join(made) + ("." if m[1] == "@" else "")

    out = [re.sub(r"([@#])(\d+)", fill, re.sub(r" Y>", ' data-y="1">', x)) for x in layouts(count, seed, part)]
    return [f"<!DOCTYPE html><html><head><title>x</title><style>p{{margin:0}}</style></head><body>{x}</body></html>" for x in out]
