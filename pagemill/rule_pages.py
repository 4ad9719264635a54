"""One page per rule of the page engine, with the content and the Markdown that must come out.

A page is an article of two paragraphs of prose and, between, before or behind them, what one rule is about.
``{name}`` stands for a customer's name, ``{first}`` and ``{last}`` in results for the two paragraphs.  The results were taken
from this engine once and then checked one by one against what each rule says; from then on they are fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.extract import extract
from .operators.pipeline import Options

_PROSE = ("The rivers of the old country run slowly through wide green valleys, and people who live there tell long stories about floods and harvests. " * 6).strip()
FIRST, LAST = "{name} begins. " + _PROSE, "{name} ends. " + _PROSE

#: (rule, where it stands, page, content, Markdown).
CASES = (
    ('RM2', 'mid', '<img src="/a.png" width="20" height="200"><img src="data:image/gif;base64,x"><img alt="kept" src="/b.png" width="50" height="50">',
     '{first}<img alt="kept" height="50" width="50" src="https://e.com/b.png">{last}',
     '{first}\n\n![kept](https://e.com/b.png)\n\n{last}'),
    ('RM3', 'mid', '<div class="promo">Buy {name}</div><div role="banner">x</div><button>b</button><aside class="callout-x">kept aside of {name} with words.</aside>',
     '{first}<aside class="callout-x">kept aside of {name} with words.</aside>{last}',
     '{first}\n\nkept aside of {name} with words.\n\n{last}'),
    ('RM4', 'mid', '<header><p>one paragraph</p></header><header><div><p>first of {name}</p><p>second of {name}</p></div></header>',
     '{first}<header><div><p>first of {name}</p><p>second of {name}</p></div></header>{last}',
     '{first}\n\nfirst of {name}\n\nsecond of {name}\n\n{last}'),
    ('RM5', 'mid', '<div style="display: none">x</div><p class="invisible">y</p><div inert="">z</div><p style="opacity:0.5">half</p><p style="color:red">Seen by {name} as well.</p>',
     '{first}<p>Seen by {name} as well.</p>{last}',
     '{first}\n\nSeen by {name} as well.\n\n{last}'),
    ('RM6', 'mid', '<div class="share-box">Tweet {name}</div><p class="kicker">K</p><pre class="share-box">code of {name}</pre><p class="main_menu">A menu of the day for {name}, kept.</p>',
     '{first}<pre><code>code of {name}</code></pre><p class="main_menu">A menu of the day for {name}, kept.</p>{last}',
     '{first}\n\n```\ncode of {name}\n```\n\nA menu of the day for {name}, kept.\n\n{last}'),
    ('RM7', 'mid', '<div><a href="/a">Share</a> <a href="/b">Subscribe now</a> <a href="/c">Follow us</a></div><div><p>{name} writes sentences that are content, and they stay where they are.</p></div>',
     '{first}<p>{name} writes sentences that are content, and they stay where they are.</p>{last}',
     '{first}\n\n{name} writes sentences that are content, and they stay where they are.\n\n{last}'),
    ('RM9', 'start', '<h1>Title of {name}</h1><p>May 3, 2024</p><p>More words of {name} follow here.</p>',
     '<h1>Title of {name}</h1><p>More words of {name} follow here.</p>{first}{last}',
     '# Title of {name}\n\nMore words of {name} follow here.\n\n{first}\n\n{last}'),
    ('RM10', 'mid', '<p><img alt="same" src="/s.png" width="50" height="50"></p><p><img alt="same" src="/l.png" width="500" height="500"></p>',
     '{first}<p></p><p><img alt="same" height="500" width="500" src="https://e.com/l.png"></p>{last}',
     '{first}\n\n![same](https://e.com/l.png)\n\n{last}'),
    ('PAT1', 'mid', '<p>5 min read</p><span>12 minutes to read</span>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT2', 'mid', '<p>By {name}</p><p>Written by the people of this place</p><p>Bystanders of {name} are no byline at all.</p>',
     '{first}<p>Bystanders of {name} are no byline at all.</p>{last}',
     '{first}\n\nBystanders of {name} are no byline at all.\n\n{last}'),
    ('PAT3', 'mid', '<p>All rights reserved</p><p>This article was published in {name}</p>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT4', 'mid', '<h2>Related posts</h2><ul><li>{name} one. Two.</li></ul><h2>Relations of {name}</h2>',
     '{first}<h2>Relations of {name}</h2>{last}',
     '{first}\n\n## Relations of {name}\n\n{last}'),
    ('PAT5', 'mid', '<p><time>May 3, 2024</time> at noon</p><p>On <time>May 3, 2024</time> many people of {name} went out to see it all.</p>',
     '{first}<p>On <time>May 3, 2024</time> many people of {name} went out to see it all.</p>{last}',
     '{first}\n\nOn May 3, 2024 many people of {name} went out to see it all.\n\n{last}'),
    ('PAT6', 'end', '<div><a href="/a">first of all</a> <a href="/b">second of all</a></div>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT7', 'start', '<div><h1>Title of {name}</h1><time>today</time></div>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT8', 'start', '<ul><li><a href="/">Home.</a></li><li><a href="#x">Here.</a></li></ul>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT9', 'start', '<a href="/x"><div>Read the offer</div></a><h2>Heading of {name}</h2>',
     '<h2>Heading of {name}</h2>{first}{last}',
     '## Heading of {name}\n\n{first}\n\n{last}'),
    ('PAT10', 'start', '<div>2024-05-03</div><h1>Title of {name}</h1>',
     '<h1>Title of {name}</h1>{first}{last}',
     '# Title of {name}\n\n{first}\n\n{last}'),
    ('PAT11', 'mid', '<p>Ann Smith | May 3, 2024</p><p>Date: May 3, 2024 for {name}</p>',
     '{first}<p>Date: May 3, 2024 for {name}</p>{last}',
     '{first}\n\nDate: May 3, 2024 for {name}\n\n{last}'),
    ('PAT12', 'start', '<p class="posted">May 3, 2024</p>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT13', 'start', '<ul><li>Category</li><li>{name}</li></ul>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT15', 'end', '<h3>Elsewhere</h3><ul><li><a href="https://a.b/1">{name} one.</a> It is good.</li><li><a href="https://a.b/2">{name} two.</a> It is better.</li></ul>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT17', 'end', '<div><h3>Topics</h3><p>few words</p></div>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT18', 'mid', '<div><p>Sign up here and get news in your inbox, {name}</p></div>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT19', 'end', '<section><p>Ann answers questions. Phone: 123 or Email: a@b.c, any day.</p></section>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT20', 'mid', '<div>Share on all networks</div><div>Authors: {name}, Bob</div>',
     '{first}<div>Authors: {name}, Bob</div>{last}',
     '{first}\n\nAuthors: {name}, Bob\n\n{last}'),
    ('PAT21', 'mid', '<span>12 likes</span><p>3 comments</p><p>12 likes of {name} are text.</p>',
     '{first}<p>12 likes of {name} are text.</p>{last}',
     '{first}\n\n12 likes of {name} are text.\n\n{last}'),
    ('PAT22', 'mid', '<p>For more on this see <a href="/x">the other pages of {name}</a></p>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT23', 'mid', '<div><div><img alt="p" src="/a.png" width="90" height="90"><h4>One</h4></div><div><img alt="q" src="/b.png" width="90" height="90"><h4>Two</h4></div></div>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('PAT24', 'mid', '<span>Pinned</span><p>Pinned by {name} is text.</p>',
     '{first}<p>Pinned by {name} is text.</p>{last}',
     '{first}\n\nPinned by {name} is text.\n\n{last}'),
    ('PAT25', 'mid', '<p>Current time in Rome: 12:00</p>',
     '{first}{last}',
     '{first}\n\n{last}'),
    ('STD1', 'mid', '<p>{name} has a very long<wbr>word.</p>',
     '{first}<p>{name} has a very longword.</p>{last}',
     '{first}\n\n{name} has a very longword.\n\n{last}'),
    ('STD2', 'mid', '<p onclick="x()" style="color:red" data-x="1" class="k" id="q" title="t">Text of {name}.</p>',
     '{first}<p class="k" id="q" title="t">Text of {name}.</p>{last}',
     '{first}\n\nText of {name}.\n\n{last}'),
    ('STD3', 'mid', '<p></p><p><br></p><span></span><p>Text of {name}.</p>',
     '{first}<p>Text of {name}.</p>{last}',
     '{first}\n\nText of {name}.\n\n{last}'),
    ('STD4', 'mid', '<h1>First of {name}</h1><p>x y z.</p><h1>Second of {name}</h1>',
     '{first}<h1>First of {name}</h1><p>x y z.</p><h2>Second of {name}</h2>{last}',
     '{first}\n\n# First of {name}\n\nx y z.\n\n## Second of {name}\n\n{last}'),
    ('STD5', 'mid', '<div><div><p>Text of {name}.</p></div></div>',
     '{first}<p>Text of {name}.</p>{last}',
     '{first}\n\nText of {name}.\n\n{last}'),
    ('STD6', 'mid', '<p><a href="c?x=1">{name}</a> <a href="//h.org/d">d</a> <a href="mailto:a@b.c">m</a></p><img alt="i" src="/i.png" srcset="/i.png 1x, /j.png 2x">',
     '{first}<p><a href="https://e.com/a/c?x=1">{name}</a> <a href="//h.org/d">d</a> <a href="mailto:a@b.c">m</a></p><img alt="i" src="https://e.com/i.png" srcset="https://e.com/i.png 1x, https://e.com/j.png 2x">{last}',
     '{first}\n\n[{name}](https://e.com/a/c?x=1) [d](//h.org/d) [m](mailto:a@b.c)\n\n![i](https://e.com/i.png)\n\n{last}'),
    ('CAN1', 'mid', '<p><img alt="lazy" src="#"><noscript><img src="https://e.com/r.png"></noscript></p>',
     '{first}<p><img alt="lazy" src="https://e.com/r.png"></p>{last}',
     '{first}\n\n![lazy](https://e.com/r.png)\n\n{last}'),
    ('CAN2', 'mid', '<div><template id="B:0"></template><i>wait</i><!--/$--></div><div hidden id="S:0"><p>Streamed text of {name}.</p></div><script>$RC("B:0","S:0")</script>',
     '{first}<p>Streamed text of {name}.</p>{last}',
     '{first}\n\nStreamed text of {name}.\n\n{last}'),
    ('CAN3', 'mid', '<object data="x">o</object><p><a href="javascript:x" onclick="y">{name}</a></p><base href="/z">',
     '{first}<p><a>{name}</a></p>{last}',
     '{first}\n\n{name}\n\n{last}'),
    ('CAN4', 'mid', '<img alt="d" src="/d.png" srcset="data:image/png;base64,AA 1x, /b.png 2x">',
     '{first}<img alt="d" src="https://e.com/d.png" srcset="data:image/png;base64,AA 1x, https://e.com/b.png 2x">{last}',
     '{first}\n\n![d](https://e.com/d.png)\n\n{last}'),
    ('MATH1', 'mid', '<p>Of {name}: <span class="katex"><span class="katex-mathml"><math><semantics><mi>a</mi><annotation encoding="application/x-tex">a^2</annotation></semantics></math></span></span>.</p>',
     '{first}<p>Of {name}: <span data-latex="a^2">a^2</span>.</p>{last}',
     '{first}\n\nOf {name}: $a^2$.\n\n{last}'),
    ('MATH3', 'mid', '<p>Of {name}: <span class="MathJax">b</span><script type="math/tex">b_1</script>.</p>',
     '{first}<p>Of {name}: <span data-latex="b_1">b_1</span>.</p>{last}',
     '{first}\n\nOf {name}: $b_1$.\n\n{last}'),
    ('MATH4', 'mid', '<p>Of {name}: <mjx-container data-latex="c^2"><mjx-math>c</mjx-math></mjx-container>.</p>',
     '{first}<p>Of {name}: <span data-latex="c^2">c^2</span>.</p>{last}',
     '{first}\n\nOf {name}: $c^2$.\n\n{last}'),
    ('MATH6', 'mid', '<p>Of {name}: <math alttext="d"><mi>d</mi></math>.</p>',
     '{first}<p>Of {name}: <math data-latex="d" xmlns="http://www.w3.org/1998/Math/MathML"><mi>d</mi></math>.</p>{last}',
     '{first}\n\nOf {name}: d.\n\n{last}'),
    ('MATH7', 'mid', '<span class="katex-display"><span class="katex"><math><semantics><mi>e</mi><annotation encoding="application/x-tex">e=mc^2</annotation></semantics></math></span></span>',
     '{first}<div data-latex="e=mc^2">e=mc^2</div>{last}',
     '{first}\n\n$$\ne=mc^2\n$$\n\n{last}'),
    ('FN1', 'mid', '<p>Text of {name}<span class="footnote-container"><span class="footnote">Side note.</span></span> goes on.</p>',
     '{first}<p>Text of {name}<sup id="fnref:1"><a href="https://e.com/a/b#fn:1">1</a></sup> goes on.</p>{last}<div id="footnotes"><div class="footnote" id="fn:1">Side note.</div></div>',
     '{first}\n\nText of {name}[^1] goes on.\n\n{last}\n\n[^1]: Side note.'),
    ('FN2 FN9 FN10', 'mid', '<p>Text of {name}.<sup id="fnref:1"><a href="#fn:1">1</a></sup></p><ol class="footnotes"><li id="fn:1">Note of {name}. <a href="#fnref:1" class="footnote-backref">back</a></li></ol>',
     '{first}<p>Text of {name}.<sup id="fnref:1"><a href="https://e.com/a/b#fn:1">1</a></sup></p>{last}<div id="footnotes"><div class="footnote" id="fn:1">Note of {name}.</div></div>',
     '{first}\n\nText of {name}.[^1]\n\n{last}\n\n[^1]: Note of {name}.'),
    ('FN3', 'mid', '<p>Text of {name}<sup>4</sup>.</p><aside><ol start="4"><li>Note of {name}.</li></ol></aside>',
     '{first}<p>Text of {name}<sup id="fnref:4"><a href="https://e.com/a/b#fn:4">4</a></sup>.</p>{last}<div id="footnotes"><div class="footnote" id="fn:4">Note of {name}.</div></div>',
     '{first}\n\nText of {name}[^4].\n\n{last}\n\n[^4]: Note of {name}.'),
    ('FN4', 'mid', '<p>Text<a href="#_ftn1">[1]</a> of {name}<a href="#_ftn2">[2]</a>.</p><p><sup><a href="#_ftnref1">[1]</a></sup> Note one.</p><p><sup><a href="#_ftnref2">[2]</a></sup> Note two.</p>',
     '{first}<p>Text<sup id="fnref:1"><a href="https://e.com/a/b#fn:1">1</a></sup> of {name}<sup id="fnref:2"><a href="https://e.com/a/b#fn:2">2</a></sup>.</p>{last}<div id="footnotes"><div class="footnote" id="fn:1">Note one.</div><div class="footnote" id="fn:2">Note two.</div></div>',
     '{first}\n\nText[^1] of {name}[^2].\n\n{last}\n\n[^1]: Note one.\n\n[^2]: Note two.'),
    ('FN5', 'mid', '<p>Text<sup id="ftnt_ref1"><a href="#ftnt1">[1]</a></sup> of {name}<sup id="ftnt_ref2"><a href="#ftnt2">[2]</a></sup>.</p><p id="ftnt1">Note one.</p><p id="ftnt2">Note two.</p>',
     '{first}<p>Text<sup id="fnref:1"><a href="https://e.com/a/b#fn:1">1</a></sup> of {name}<sup id="fnref:2"><a href="https://e.com/a/b#fn:2">2</a></sup>.</p>{last}<div id="footnotes"><div class="footnote" id="fn:1">Note one.</div><div class="footnote" id="fn:2">Note two.</div></div>',
     '{first}\n\nText[^1] of {name}[^2].\n\n{last}\n\n[^1]: Note one.\n\n[^2]: Note two.'),
    ('FN6', 'mid', '<p>Text <a href="#n1">1</a> of {name} <a href="#n2">2</a>.</p><div><p id="n1">Note one.</p><p id="n2">Note two.</p></div>',
     '{first}<p>Text <sup id="fnref:1"><a href="https://e.com/a/b#fn:1">1</a></sup> of {name} <sup id="fnref:2"><a href="https://e.com/a/b#fn:2">2</a></sup>.</p>{last}<div id="footnotes"><div class="footnote" id="fn:1">Note one.</div><div class="footnote" id="fn:2">Note two.</div></div>',
     '{first}\n\nText [^1] of {name} [^2].\n\n{last}\n\n[^1]: Note one.\n\n[^2]: Note two.'),
    ('CALL1', 'mid', '<div class="callout is-collapsed" data-callout="note"><p>Title</p><p>Note of {name}.</p></div>',
     '{first}<div class="callout is-collapsed" data-callout="note" data-callout-fold="-"><p>Title</p><p>Note of {name}.</p></div>{last}',
     '{first}\n\nTitle\n\nNote of {name}.\n\n{last}'),
    ('CALL3', 'mid', '<div class="admonition warning"><p class="admonition-title">Careful</p><p>Warning of {name}.</p></div>',
     '{first}<div class="admonition warning" data-callout="warning" data-callout-title="Careful"><p class="admonition-title">Careful</p><p>Warning of {name}.</p></div>{last}',
     '{first}\n\nCareful\n\nWarning of {name}.\n\n{last}'),
    ('CALL4', 'mid', '<div class="alert alert-info"><p>Info of {name}.</p><p>And more of it.</p></div><div class="alert alert-info alert-dismissible"><p>gone</p><p>with it</p></div>',
     '{first}<div class="alert alert-info" data-callout="info" data-callout-title="Info"><p>Info of {name}.</p><p>And more of it.</p></div>{last}',
     '{first}\n\nInfo of {name}.\n\nAnd more of it.\n\n{last}'),
    ('CALL5', 'mid', '<blockquote><p>[!NOTE] Said of {name}.</p></blockquote>',
     '{first}<blockquote data-callout="note" data-callout-title="Note"><p>[!NOTE] Said of {name}.</p></blockquote>{last}',
     '{first}\n\n> \\[!NOTE\\] Said of {name}.\n\n{last}'),
    ('CODE1', 'mid', '<pre><code class="language-python"><span class="line-number">1</span>x = 1\n<span class="line-number">2</span>y = 2</code></pre>',
     '{first}<pre><code data-lang="python">x = 1\ny = 2</code></pre>{last}',
     '{first}\n\n```\nx = 1\ny = 2\n```\n\n{last}'),
    ('CODE2', 'mid', '<div class="highlight"><pre><code>run {name}</code></pre><button class="copy-button">Copy</button><span class="copy-btn">Copy</span></div>',
     '{first}<div class="highlight"><pre><code>run {name}</code></pre></div>{last}',
     '{first}\n\n```\nrun {name}\n```\n\n{last}'),
    ('CODE3', 'mid', '<pre data-lang="rust"><code>fn main() {}</code></pre><pre class="brush: js"><code>a()</code></pre>',
     '{first}<pre><code data-lang="rust">fn main() {}</code></pre><pre><code data-lang="js">a()</code></pre>{last}',
     '{first}\n\n```\nfn main() {}\n```\n\n```\na()\n```\n\n{last}'),
    ('CODE4', 'mid', '<pre class="k">\tone<br>two\xa0three\n\n\n\nfour</pre>',
     '{first}<pre><code>one\ntwo three\n\nfour</code></pre>{last}',
     '{first}\n\n```\none\ntwo three\n\nfour\n```\n\n{last}'),
    ('PRE1', 'mid', '<!-- <p>hidden {name}</p> --><p>Text of {name}.</p>',
     '{first}<!-- �p�hidden {name}�/p� --><p>Text of {name}.</p>{last}',
     '{first}\n\nText of {name}.\n\n{last}'),
    ('PRE2', 'mid', '<p>Smile &#xD83D;&#xDE00; of {name} and &#55357;&#56832;.</p>',
     '{first}<p>Smile 😀 of {name} and 😀.</p>{last}',
     '{first}\n\nSmile 😀 of {name} and 😀.\n\n{last}'),
    ('MD1', 'mid', '<h2>Heading of {name}</h2><p>a <strong>b</strong> <em>c</em> <code>d*e</code> f_g</p><ul><li>one<ul><li>two</li></ul></li></ul><ol start="3"><li>three</li></ol><blockquote><p>quote</p></blockquote><hr>',
     '{first}<h2>Heading of {name}</h2><p>a <strong>b</strong> <em>c</em> <code>d*e</code> f_g</p><ul><li>one<ul><li>two</li></ul></li></ul><ol><li>three</li></ol><blockquote><p>quote</p></blockquote><hr>{last}',
     '{first}\n\n## Heading of {name}\n\na **b** *c* `d*e` f\\_g\n\n*   one\n    *   two\n\n1.  three\n\n> quote\n\n* * *\n\n{last}'),
    ('MD1 tables', 'mid', '<table><thead><tr><th>a</th><th>head</th></tr></thead><tbody><tr><td>1</td><td>2|3</td></tr></tbody></table>',
     '{first}<table><thead><tr><th>a</th><th>head</th></tr></thead><tbody><tr><td>1</td><td>2|3</td></tr></tbody></table>{last}',
     '{first}\n\n| a   | head |\n| --- | ---- |\n| 1   | 2\\|3 |\n\n{last}'),
    ('MD2', 'mid', '<iframe src="https://www.youtube.com/embed/k1"></iframe>',
     '{first}<iframe src="https://www.youtube.com/embed/k1"></iframe>{last}',
     '{first}\n\n![](https://www.youtube.com/watch?v=k1)\n\n{last}'),
    ('MD6', 'mid', '<p>wow!<a href="/p"><img alt="{name}" src="/i.png"></a></p>',
     '{first}<p>wow!<a href="https://e.com/p"><img alt="{name}" src="https://e.com/i.png"></a></p>{last}',
     '{first}\n\nwow! [![{name}](https://e.com/i.png)](https://e.com/p)\n\n{last}'),
)


#: (rule, head of a page, fields that have a value); the icon is the host's where none is named.
HEADS = (
    ('MET1', '<meta name="twitter:title" content="{name} story"><title>Other</title>',
     {'title': '{name} story'}),
    ('MET2 MET3', '<meta property="og:title" content="{name} story | Daily Site"><meta property="og:site_name" content="Daily Site"><title>{name} story | Daily Site</title>',
     {'title': '{name} story', 'site': 'Daily Site'}),
    ('MET4 MET5', '<title>{name} writes a long story - Example</title>',
     {'title': '{name} writes a long story', 'site': 'Example'}),
    ('MET6', '<meta name="citation_author" content="Doe, Ann">',
     {'author': 'Ann Doe', 'site': 'Ann Doe'}),
    ('MET6 schema', '<script type="application/ld+json">{"@type": "Article", "headline": "{name} headline", "author": [{"name": "Ann"}, {"name": "Bob"}]}</script>',
     {'title': '{name} headline', 'author': 'Ann, Bob', 'content_type': 'Article'}),
    ('MET7', '<meta name="author" content="{name} - https://x.org/a">',
     {'author': '{name}', 'site': '{name}'}),
    ('MET8', '<meta name="parsely-pub-date" content="2024-02-03"><meta property="article:published_time" content="2024-05-06">',
     {'published': '2024-05-06'}),
    ('MET8 schema', '<script type="application/ld+json">[{"@type": "Thing"}, {"@type": "NewsArticle", "datePublished": "2024-07-08"}]</script>',
     {'published': '2024-07-08', 'content_type': 'Thing'}),
    ('MET10', '<meta property="og:updated_time" content="2024-02-03"><meta http-equiv="Last-Modified" content="2020-01-01">',
     {'modified': '2024-02-03'}),
    ('MET11', '<script type="application/ld+json">{"@type": "Article", "publisher": {"name": "{name} Press"}}</script><meta property="og:site_name" content="Other">',
     {'site': '{name} Press', 'content_type': 'Article'}),
    ('MET11 JSN4', '<script type="application/ld+json">{"@context": "x", "@graph": [{"@type": "WebSite", "name": "Graph Site"}, {"@type": "Article", "description": "of {name}"}]}</script>',
     {'description': 'of {name}', 'content_type': 'Article'}),
    ('MET12', '<meta property="og:description" content="og"><meta name="description" content="about {name}">',
     {'description': 'about {name}'}),
    ('MET13', '<meta name="twitter:image" content="https://e.com/t.png"><meta property="og:image" content="https://e.com/o.png">',
     {'image': 'https://e.com/o.png'}),
    ('MET13 schema', '<script type="application/ld+json">{"@type": "Article", "image": [{"url": "https://e.com/s.png"}]}</script>',
     {'image': 'https://e.com/s.png', 'content_type': 'Article'}),
    ('MET14', '<meta property="og:locale" content="pt_BR">',
     {'language': 'pt-BR'}),
    ('MET15 MET17', '<link rel="shortcut icon" href="/f.png"><link rel="canonical" href="/canon">',
     {'favicon': 'https://www.example.com/f.png', 'canonical_url': 'https://www.example.com/canon'}),
    ('MET17', '<meta property="og:url" content="https://e.com/og">',
     {'canonical_url': 'https://e.com/og'}),
    ('MET18', '<meta property="article:tag" content="a"><meta property="article:tag" content="{name}">',
     {'keywords': 'a|{name}'}),
    ('MET18 news', '<meta name="news_keywords" content="x, , {name}">',
     {'keywords': 'x|{name}'}),
    ('MET19', '<meta property="og:type" content="article">',
     {'content_type': 'article'}),
    ('MET19 schema', '<script type="application/ld+json">{"@type": ["WebPage", "Recipe"]}</script>',
     {}),
    ('JSN1 JSN2', '<script type="application/ld+json">{bad</script><script type="application/ld+json"><![CDATA[ {"@type": "Article", /* c */ "headline": "{name} // not a comment"} ]]></script>',
     {'title': '{name} // not a comment', 'content_type': 'Article'}),
    ('JSN3', '<script type="application/ld+json">{"@type": "Article", "headline": "{name} &amp;amp; &#66;ob"}</script>',
     {'title': '{name} &amp; Bob', 'content_type': 'Article'}),
)
FIELDS = "title author site published modified description image language favicon canonical_url keywords content_type".split()


def _page(place: str, html: str) -> str:
    first, last = f"<p>{FIRST}</p>", f"<p>{LAST}</p>"
    parts = {"mid": (first, html, last), "end": (first, last, html), "start": (html, first, last)}[place]
    return f"<html><body><article>{''.join(parts)}</article></body></html>"


def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on pages of many names."""
    cases = spark.createDataFrame([(k, rule, _page(place, html)) for k, (rule, place, html, _, _) in enumerate(CASES)], "kind long, rule string, html string")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").withColumn("kind", F.pmod("c_custkey", F.lit(len(CASES))))
    rows = customers.join(F.broadcast(cases), "kind").withColumn("html", F.replace("html", F.lit("{name}"), F.col("c_name")))  # one row per rule
    rows = rows.repartition(spark.sparkContext.defaultParallelism).withColumn("url", F.lit("https://e.com/a/b"))
    out = extract(rows, Options(separate_markdown=True))
    return out.select("c_custkey", "rule", "page.content", F.col("page.content_markdown").alias("markdown"))


def rule_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of metadata on pages of many names."""
    body = "<body><article><p>Words of {name} that make up the text of this page.</p></article></body></html>"
    cases = spark.createDataFrame([(k, rule, f"<html><head>{head}</head>{body}") for k, (rule, head, _) in enumerate(HEADS)], "kind long, rule string, html string")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").withColumn("kind", F.pmod("c_custkey", F.lit(len(HEADS))))
    customers = customers.repartition(spark.sparkContext.defaultParallelism)  # a small file is one split, but its pages take long
    rows = customers.join(F.broadcast(cases), "kind").withColumn("html", F.replace("html", F.lit("{name}"), F.col("c_name")))  # one row per rule
    out = extract(rows.withColumn("url", F.lit("https://www.example.com/p")))
    keywords = F.when(F.size("page.keywords") > 0, F.array_join("page.keywords", "|")).alias("keywords")
    return out.select("c_custkey", "rule", *[keywords if f == "keywords" else F.col(f"page.{f}").alias(f) for f in FIELDS])


def _quoted(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    content = [f"<article>{c.replace('{first}', f'<p>{FIRST}</p>').replace('{last}', f'<p>{LAST}</p>')}</article>" for _, _, _, c, _ in CASES]
    markdown = [m.replace("{first}", FIRST).replace("{last}", LAST) for *_, m in CASES]
    values = ", ".join(f"({k}, {_quoted(rule)}, {_quoted(c)}, {_quoted(m)})" for k, ((rule, *_), c, m) in enumerate(zip(CASES, content, markdown)))
    fill = lambda c: f"replace({c}, '{{name}}', c_name) AS {c}"
    return f"WITH cases(kind, rule, content, markdown) AS (VALUES {values}) SELECT c_custkey, rule, {fill('content')}, {fill('markdown')} FROM customer JOIN cases ON c_custkey % {len(CASES)} = kind"


def _metadata_sql() -> str:
    icon = {"favicon": "https://www.example.com/favicon.ico"}
    values = ", ".join(f"({k}, {_quoted(rule)}, {', '.join(_quoted((icon | found).get(f)) for f in FIELDS)})" for k, (rule, _, found) in enumerate(HEADS))
    filled = ", ".join(f"replace({f}, '{{name}}', c_name) AS {f}" for f in FIELDS)
    return f"WITH cases(kind, rule, {', '.join(FIELDS)}) AS (VALUES {values}) SELECT c_custkey, rule, {filled} FROM customer JOIN cases ON c_custkey % {len(HEADS)} = kind"


QUERIES = {"rule_pages": rule_pages, "rule_metadata": rule_metadata}
ORACLE_SQL = {"rule_pages": _sql(), "rule_metadata": _metadata_sql()}
