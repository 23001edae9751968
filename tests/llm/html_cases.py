"""Hand-written pages with the text that a reader would take for the article: (page, its lines)."""

_TOP = '<header class="site-header"><a href="/">The Daily Lamp</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>'
_END = '<footer class="site-footer"><p>&copy; 2024 The Daily Lamp. All rights reserved.</p><a href="/p">Privacy</a> <a href="/t">Terms</a></footer>'
_A = "The council met on Tuesday to discuss the new bridge, which has been closed since the storm in March."
_B = "Engineers said that repairs would take at least four months. Traffic is being sent through the old town."
_C = "Residents have complained about noise, dust and long queues at the crossing near the school."
_D = "A final decision is expected before the summer break, when the contract has to be signed."


def _page(body, head="<title>Bridge</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (_page(f"{_TOP}<article><h1>Bridge closed</h1><p>{_A}</p><p>{_B}</p></article>{_END}"), ["Bridge closed", _A, _B]),
    (_page(f"{_TOP}<main><article><div><div><h1>Bridge closed</h1><p>{_A}</p></div><p>{_B}</p></div></article></main>{_END}"), ["Bridge closed", _A, _B]),
    (_page(f"{_TOP}<div id=content><h1>Bridge closed</h1><p>{_A}<p>{_B}<p>{_C}</div>{_END}"), ["Bridge closed", _A, _B, _C]),
    (_page(f"<nav><a href=/>Home</a> <a href=/b>Blog</a></nav><div><p>{_A}</p><p>{_B}</p></div><p>{_C}</p>"), [_A, _B, _C]),
    (_page(f"{_TOP}<article><header><h1>Bridge closed</h1></header><section><h2>What happened</h2><p>{_A}</p></section><section><h2>What next</h2><p>{_D}</p></section></article>{_END}"),
     ["Bridge closed", "What happened", _A, "What next", _D]),
    (_page(f'{_TOP}<article><h1>Bridge</h1><p>{_A}</p><div class="ad"><p>Buy two lamps, get one free. Only this week!</p></div><p>{_B}</p></article>{_END}'), ["Bridge", _A, _B]),
    (_page(f'{_TOP}<article><p>{_A}</p><aside class="related"><h3>Related</h3><ul><li><a href=1>Storm hits coast</a><li><a href=2>Roads flooded again</a></ul></aside><p>{_C}</p></article>{_END}'), [_A, _C]),
    (_page(f'{_TOP}<main><h1>Bridge</h1><p>{_A}</p><p>{_B}</p></main><section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I drive there daily, it is a mess.</p></div><div class="comment"><b>Bo</b><p>Same here. They should have acted sooner.</p></div></section>{_END}'), ["Bridge", _A, _B]),
    (_page(f'<div class="cookie-banner"><p>We use cookies to make the site better. Read our policy.</p><button>OK</button></div>{_TOP}<div class="post-body"><p>{_A}</p><p>{_D}</p></div>{_END}'), [_A, _D]),
    (_page(f'{_TOP}<div class="wrapper"><div class="entry"><h1>Bridge</h1><p>{_A}</p><ul><li>four months of work</li><li>two lanes</li><li>one crossing</li></ul><p>{_B}</p></div><div class="sidebar"><h3>Popular</h3><a href=1>Ten best lamps</a><a href=2>How to wire a lamp</a></div></div>{_END}'),
     ["Bridge", _A, "four months of work", "two lanes", "one crossing", _B]),
    (_page(f'{_TOP}<article><h1>Cost</h1><p>{_A}</p><table><tr><th>Item</th><th>Price</th></tr><tr><td>Steel</td><td>40</td></tr><tr><td>Labour</td><td>75</td></tr></table><p>{_D}</p></article>{_END}'),
     ["Cost", _A, "Item", "Price", "Steel", "40", "Labour", "75", _D]),
    (_page(f'{_TOP}<article><figure><img src=b.jpg><figcaption>The bridge after the storm.</figcaption></figure><p>{_A}</p><blockquote><p>It will take time, the mayor said.</p></blockquote><p>{_B}</p></article>{_END}'),
     ["The bridge after the storm.", _A, "It will take time, the mayor said.", _B]),
    (_page(f'{_TOP}<article><p>{_A}</p><p>See <a href="/x"">the report</a> for more on this.</p><p>{_B}</p></article>{_END}'), [_A, "See the report for more on this.", _B]),
    (_page(f'{_TOP}<article><p "odd>{_A}</p><p>{_B}</p></article>{_END}'), [_A, _B]),
    (_page(f'{_TOP}<article>{"<div>" * 260}<p>{_A}</p><p>{_B}</p>{"</div>" * 260}</article>{_END}'), [_A, _B]),
    (_page(f'{_TOP}<article><p>{_A}</p><div class="story-related"><p>{_B}</p></div><p>{_C}</p></article>{_END}'), [_A, _B, _C]),
    (_page(f'{_TOP}<article><p>{_A}</p><form action=/s><label>Your mail</label><input name=m><button>Sign up</button></form><p>{_B}</p></article>{_END}'), [_A, _B]),
    (_page(f'{_TOP}<article><p>{_A}</p><script>if (a < b) document.write("<p>no</p>");</script><style>p{{color:red}}</style><p>{_B}</p></article>{_END}'), [_A, _B]),
    (f"<p>{_A}</p><p>{_B}</p>", [_A, _B]),
    (f"<div><p>{_A}</p><svg><title>x</title></svg><p>{_B}</p><select><option>one</select></div>", [_A, _B]),
    (_page(f'{_TOP}<div class="page"><div class="row"><div class="col-8"><h2>Bridge</h2><p>{_A}</p><p>{_B}</p><p>{_C}</p></div><div class="col-4 widget"><h4>Newsletter</h4><form><input><button>Go</button></form></div></div></div>{_END}'), ["Bridge", _A, _B, _C]),
    (_page(f'<div class="masthead"><h1>The Daily Lamp</h1></div><div class="menu"><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><section class="article-text"><h1>Bridge</h1><p>{_A}</p><p>{_D}</p></section><div class="footer">Copyright The Daily Lamp</div>'), ["Bridge", _A, _D]),
    (_page(f'{_TOP}<article><h1>Caf&eacute; &amp; bridge</h1><p>1 &lt; 2 &#8212; {_A}</p><p>A&nbsp;b   c\n\t d.</p></article>{_END}'), ["Café & bridge", f"1 < 2 — {_A}", "A b c d."]),
    (_page(f'{_TOP}<article><dl><dt>Span</dt><dd>Forty metres of steel, in two parts.</dd><dt>Age</dt><dd>Built in 1931 and widened in 1968.</dd></dl><p>{_A}</p></article>{_END}'),
     ["Span", "Forty metres of steel, in two parts.", "Age", "Built in 1931 and widened in 1968.", _A]),
    (_page(f'{_TOP}<main class="layout"><article class="post"><h1>Bridge</h1><div class="post-content"><p>{_A}</p><h2>Delays</h2><p>{_B}</p></div><div class="share"><span><a href=f>Share</a></span><span><a href=t>Send</a></span></div></article><aside><p>Our reader offer: lamps at half the price.</p></aside></main>{_END}'),
     ["Bridge", _A, "Delays", _B]),
    (_page(f'<table><tr><td><ul><li><a href=1>Home</a><li><a href=2>Links</a><li><a href=3>Guestbook</a></ul></td><td><h1>My bridge page</h1><p>{_A}</p><p>{_C}</p></td></tr></table>'), ["My bridge page", _A, _C]),
    (_page(f'{_TOP}<article><pre><code>make bridge --steel 40</code></pre><p>{_A}</p><p>Run the command above.</p></article>{_END}'), ["make bridge --steel 40", _A, "Run the command above."]),
    (_page(f'{_TOP}<article><h1>Bridge</h1>{_A}<br><br>{_B}<p>{_C}</p></article>{_END}'), ["Bridge", f"{_A} {_B}", _C]),
    (_page(f'{_TOP}<nav class="breadcrumb"><a href=/>Home</a> &gt; <a href=/n>News</a></nav><article><h1>Bridge</h1><p>{_A}</p><p><a href=/map>See the map of all closed roads</a></p><p>{_B}</p></article><div class="pagination"><a href=1>1</a><a href=2>2</a></div>{_END}'),
     ["Bridge", _A, "See the map of all closed roads", _B]),
    (_page(f'{_TOP}<article><section><div><section><div><h2>Part one</h2><p>{_A}</p></div></section></div></section><section><div><h2>Part two</h2><p>{_B}</p><p>{_C}</p></div></section></article>{_END}'),
     ["Part one", _A, "Part two", _B, _C]),
    (_page(f'{_TOP}<main><article><h1>Bridge</h1><p>{_A}</p><p>{_B}</p></article><div class="more-stories"><article><h4><a href=1>Storm damage grows</a></h4><p>Roofs lost.</p></article><article><h4><a href=2>Ferry back in use</a></h4><p>Two trips a day.</p></article></div></main>{_END}'), ["Bridge", _A, _B]),
    (_page(f'{_TOP}<article><p>{_A}</p><ol class="comment-list"><li class="comment"><p>First! And a good text it is.</p><li class="comment"><p>Not so sure about that.</p></ol></article>{_END}'), [_A]),
    (_page(f"{_TOP}<article><h1>Bridge</h1><p>{_A}</p><p>Short.</p><p>Yes!</p><p>{_D}</p><p>No.</p></article>{_END}"), ["Bridge", _A, "Short.", "Yes!", _D, "No."]),
    (_page(f"{_TOP}<article><h1>Bridge</h1><div>{_A}</div><div>{_B}</div><div><span>{_C}</span></div></article>{_END}"), ["Bridge", _A, _B, _C]),
    (_page(f'{_TOP}<!-- <p>old</p> --><article><p>{_A}</p><!--><p>{_B}</p><!-- x --!><p>{_C}</p></article>{_END}'), [_A, _B, _C]),
    (_page(f'{_TOP}<div role="main"><h1>Bridge</h1><p>{_A}</p><details><summary>More</summary><p>{_B}</p></details></div>{_END}'), ["Bridge", _A, "More", _B]),
]
