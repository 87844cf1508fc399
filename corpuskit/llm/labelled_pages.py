"""Hand-made pages whose elements are marked as content (``data-content``), to train the page model.

Invented pages of common builds: articles, blogs, news, manuals, forums and plain documents, with menus, notices, adverts, forms, comments and the like around.
"""

_LONG = "The morning train was late again, and nobody on the platform seemed surprised. A clerk explained that a signal had failed somewhere beyond the river, and that a crew was on its way."
_MORE = "By noon the line was clear. Passengers who had waited since dawn were given tea and a free ticket, which most of them folded away without a word."
_LAST = "Whether the new signals will help remains to be seen; the ministry expects a report before winter."
_SHORT = "Delays are common."

# Boxes that stand around or inside the main text without belonging to it.
_BOXES = (
    f'<div class="ad">{_MORE}</div>',
    f'<div class="advert"><p>{_LAST}</p></div>',
    f'<aside><h3>{_SHORT}</h3><p>{_LONG}</p></aside>',
    f'<div class="related"><a href="/r">{_LAST}</a></div>',
    f'<section class="comments"><h2>{_SHORT}</h2><div class="comment"><p>{_LONG}</p></div><p>{_SHORT}</p></section>',
    f'<div id="comments"><p>{_LAST}</p></div>',
    f'<ol class="comment-list"><li><p>{_MORE}</p></li></ol>',
    f'<form action="/go"><label>{_SHORT}</label><p>{_SHORT}</p><button>Go</button></form>',
    f'<div class="cookie-notice"><p>{_LONG}</p></div>',
    f'<div class="popup"><h3>{_SHORT}</h3><p>{_LAST}</p></div>',
    f'<div role="dialog"><p>{_MORE}</p></div>',
    f'<div role="alert">{_LONG}</div>',
    f'<div class="newsletter-signup"><h3>{_SHORT}</h3><p>{_MORE}</p></div>',
    f'<div class="banner">{_SHORT}</div>',
    f'<div class="share"><a href="/s">{_SHORT}</a></div>',
    f'<div class="sidebar"><ul><li>{_MORE}</li></ul></div>',
    f'<nav><ul><li><a href="/n">{_SHORT}</a></li></ul></nav>',
    f'<footer><p>{_LAST}</p></footer>',
)
_WRAPS = (
    ('<article data-content="1">', "</article>"),
    ('<main data-content="1">', "</main>"),
    ('<div class="content" data-content="1">', "</div>"),
    ('<section data-content="1">', "</section>"),
    ('<div data-content="1">', "</div>"),
    ('<main><article data-content="1">', "</article></main>"),
    ('<div role="main" data-content="1">', "</div>"),
    ('<div class="container"><div class="entry-content" data-content="1">', "</div></div>"),
)


def _boxed(k: int, box: str) -> str:
    """A page with one box in front of, inside and behind the main text."""
    start, end = _WRAPS[k % len(_WRAPS)]
    inside = box.replace(">", ' data-content="0">', 1)
    return f"<html><body>{box}{start}<h1>{_SHORT}</h1><p>{_LONG}</p>{inside}<h2>{_SHORT}</h2><p>{_SHORT}</p><ul><li>{_LAST}</li></ul><blockquote>{_MORE}</blockquote><table><tr><td>{_SHORT}</td></tr></table>{end}{box}</body></html>"


def _bare(k: int, box: str) -> str:
    """A page whose main text has no element of its own, with boxes around it."""
    start, end = (("", ""), ("<div>", "</div>"), ('<div class="wrapper">', "</div>"))[k % 3]
    tags = (("h1", _SHORT), ("p", _LONG), ("h2", _SHORT), ("p", _SHORT), ("p", _MORE), ("blockquote", _LAST), ("p", _LAST))
    text = "".join(f'<{t} data-content="1">{body}</{t}>' for t, body in tags)
    return f'<html><body>{box}{start}{text}<ul data-content="1"><li>{_SHORT}</li><li>{_LAST}</li></ul><table data-content="1"><tr><td>{_SHORT}</td></tr></table>{end}{box}</body></html>'


def _nested(k: int, box: str) -> str:
    """A boxed page whose body lies in several layers of plain elements, as many sites are built."""
    layers = 2 + k % 9
    opened = "".join(f'<div class="layer{i}">' if i % 2 else "<div>" for i in range(layers))
    return _boxed(k, box).replace("<body>", f"<body>{opened}", 1).replace("</body>", "</div>" * layers + "</body>")


PAGES = (
    f"""<html><head><title>Trains</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>
    <div class="ad">Buy cheap tickets now, today only.</div><article data-content="1"><h1>Late trains</h1><p><b>{_LONG}</b></p><p>{_MORE}</p><p>{_SHORT}</p></article>
    <footer>&copy; 2020 Railway Post</footer></body></html>""",
    f"""<body><header><a href="/">Railway Post</a><form action="/s"><input name="q"><button>Search</button></form></header><nav class="menu"><a href="/a">World</a> <a href="/b">Sport</a></nav>
    <main><article data-content="1"><h1>Signals fail</h1><p>{_LONG}</p><h2>What happened</h2><p>{_MORE}</p><ul><li>One crew was sent out at dawn.</li><li>{_LAST}</li></ul>
    <aside data-content="0" class="related"><h3>Read more</h3><a href="/x">Ferries on strike</a></aside><p>{_LAST}</p></article></main>
    <aside><h3>Most read</h3><ul><li><a href="/1">A long winter</a></li><li><a href="/2">Bread prices</a></li></ul></aside><footer><p>Contact us by mail. All rights reserved.</p></footer></body>""",
    f"""<div id="page"><div id="header"><h1>My small blog</h1></div><div id="menu"><ul><li><a href="/">Start</a></li><li><a href="/old">Archive</a></li></ul></div>
    <div id="content"><div class="post" data-content="1"><h2>On waiting</h2><p>{_LONG}</p><p>{_MORE}</p><blockquote>{_LAST}</blockquote><p>{_SHORT}</p></div>
    <div id="comments"><h3>2 comments</h3><div class="comment"><p>I waited there too, and it was cold. Nobody told us anything for hours.</p></div><div class="comment"><p>Nice text!</p></div>
    <form><label>Your name</label><p>Leave a reply below.</p></form></div></div><div id="sidebar"><h3>About me</h3><p>I write about trains and rivers, mostly in winter.</p></div></div>""",
    f"""<body><div class="cookie-notice"><p>We use cookies to give you the best experience on our site.</p><button>Accept</button></div><div class="banner">Subscribe and save half the price of your first year.</div>
    <div class="wrapper"><section class="article-body" data-content="1"><h1>The river line</h1><p>{_MORE}</p><p>{_LONG}</p><table><tr><th>Station</th><th>Delay</th></tr><tr><td>Lower bridge</td><td>40 minutes</td></tr></table></section>
    <div class="newsletter"><p>Get our letter every Friday, straight to your mailbox.</p></div></div><div class="footer"><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></body>""",
    f"""<body><h1 data-content="1">A plain page</h1><p data-content="1">{_LONG}</p><p data-content="1">{_MORE}</p><p data-content="1">{_LAST}</p><hr><p><a href="/">back</a></p></body>""",
    f"""<body><div role="navigation"><a href="/">Up</a> | <a href="/n">Next</a></div><div role="main" data-content="1"><h1>Manual</h1><p>{_LONG}</p><pre>run --all
    stop</pre><ol><li>{_SHORT}</li><li>{_MORE}</li></ol><dl><dt>Crew</dt><dd>People who mend signals.</dd></dl></div><div role="alert">This page is out of date.</div><div role="contentinfo">Made by hand</div></body>""",
    f"""<html><body><header><h1>Evening Paper</h1><p>Your daily paper since 1901</p></header><nav><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/l">Local</a></li></ol></nav>
    <article data-content="1"><header><h1>New signals promised</h1></header><p>{_LAST}</p><figure><figcaption>The old bridge at noon.</figcaption></figure><p>{_LONG}</p><div data-content="0" class="advertisement"><p>Fly south this winter with us, from nine crowns.</p></div><p>{_MORE}</p>
    <div data-content="0" class="share"><a href="/f">Share</a> <a href="/t">Post</a></div></article><section id="comments"><h2>Readers say</h2><article class="comment"><p>They promised that ten years ago as well, if I remember right.</p></article></section>
    <footer><p>Evening Paper, Mill Street 4</p></footer></body></html>""",
    f"""<body><nav><a href="/">Home</a></nav><div class="container"><div class="row"><div class="main" data-content="1"><h1>Bread</h1><p>{_MORE}<br>{_SHORT}</p><p>{_LONG}</p></div><div class="sidebar"><div class="widget"><h4>Tags</h4><a href="/a">bread</a> <a href="/b">rail</a></div>
    <div class="widget ad"><p>The best ovens are sold here, come and look.</p></div></div></div></div><form class="login"><p>Log in to comment.</p></form><footer>Bread and rail, 1999</footer></body>""",
    f"""<body><section class="popup"><h2>Wait!</h2><p>Take ten percent off when you sign up for our letters today.</p></section><article data-content="1"><h1>Winter</h1><section><h2>First</h2><p>{_LONG}</p></section><section><h2>Second</h2><p>{_LAST}</p><p>{_SHORT}</p></section></article>
    <section class="comments"><p>First! I think the report will never come, but who knows.</p><form><p>Write something nice.</p></form></section><aside class="sponsored"><p>Warm coats for cold platforms, free delivery.</p></aside></body>""",
    f"""<body><div class="topbar">Call us: 555 0100</div><ul class="nav"><li><a href="/">Home</a></li><li><a href="/shop">Shop</a></li></ul><div class="entry-content" data-content="1"><p>{_MORE}</p><h3>Later</h3><p>{_LAST}</p><p>{_LONG}</p></div><div class="copyright">Copyright by the station</div></body>""",
    f"""<body><nav><p>Choose a section from the list below, or use the search field to look for older reports, photographs and letters in our archive.</p><ul><li><a href="/a">Archive</a></li></ul></nav>
    <div class="ad">{_MORE} {_SHORT}</div><article data-content="1"><h1>{_SHORT}</h1><p>{_LONG}</p><p>{_MORE}</p></article><footer>&copy; Railway Post. {_LAST} {_SHORT} All rights reserved.</footer></body>""",
    f"""<body><header><h1>Night Paper</h1><p>{_LAST} Founded by three brothers in a cellar, and printed there ever since.</p></header><div class="cookie-banner"><p>{_MORE} We and our partners store data on your device to improve what you see.</p></div>
    <main data-content="1"><h1>Rivers</h1><p>{_LONG}</p><p>{_SHORT}</p></main><section class="comments"><div class="comment"><p>{_MORE} {_LAST}</p></div><div class="comment"><p>{_LONG}</p></div></section>
    <aside><p>{_LAST} {_MORE}</p></aside><footer><p>{_LONG} Printed on the river bank, with ink and patience, by the same family.</p></footer></body>""",
    f"""<body><div class="notice"><p>{_LAST} Please read our new terms, which are valid from the first of next month for all readers.</p></div><div class="content" data-content="1"><h2>Letters</h2><p>{_SHORT}</p><p>{_LONG}</p>{_MORE}</div>
    <div class="sidebar">{_LONG}<p>{_SHORT}</p></div><div class="promo">{_MORE}</div><form><p>{_LAST} Fill in the form and we shall write back within a week or two.</p></form><div id="footer">{_LAST} {_SHORT}</div></body>""",
    f"""<body><aside class="ad"><p>{_LONG}</p></aside><nav>{_MORE}</nav><article data-content="1"><h1>Tea</h1>{_LONG}<p>{_MORE}</p></article><div class="comments"><p>{_LONG}</p><p>{_SHORT}</p></div><form>{_LAST}</form><footer>{_MORE}</footer></body>""",
    f"""<body><header><p>{_LAST}</p><h2>Weekly Rail</h2></header><p data-content="1">{_MORE}</p><p data-content="1">{_LONG}</p><h2 data-content="1">Then</h2><p data-content="1">{_SHORT}</p><p data-content="1">{_LAST}</p><footer>{_LONG}</footer></body>""",
    f"""<body><h1 data-content="1">Notes</h1><p data-content="1">{_SHORT}</p><p data-content="1">{_LONG}</p><ul data-content="1"><li>{_SHORT}</li><li>{_LAST}</li></ul><p data-content="1">{_MORE}</p><p data-content="1">{_SHORT}</p></body>""",
    *(_boxed(k, box) for k, box in enumerate(_BOXES)),
    *(_bare(k, box) for k, box in enumerate(_BOXES[::2])),
    *(_nested(k, box) for k, box in enumerate(_BOXES)),
)
