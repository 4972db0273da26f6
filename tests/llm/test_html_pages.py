"""Main text of hand-written pages: containers without a name, adverts, notices, hidden parts and comments of many kinds. They were written before the training layouts."""

import pytest

from vesper.llm import html

A = "The council met on Tuesday to discuss the new bridge, which has been planned for years. Several members spoke against it."
B = "Work is to begin in spring, the mayor said, if the money can be found. The last bridge on this site fell in 1921."
C = "Residents who live near the river have asked for a wall against the floods. No answer has been given so far."
D = "A report by two engineers found that the ground on the eastern bank is too soft, and that piles of forty metres would be needed."
T = "A new bridge for the town"
NAV = "<nav><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></nav>"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
FOOT = "<footer>&copy; 2021 The Paper. All rights reserved.</footer>"
ALL = [A, B, C]
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"

PAGES = {
    # main text in containers that say nothing
    "bare body": (f"<body>{BODY}</body>", ALL),
    "bare body with title": (f"<html><head><title>x</title></head><body><h1>{T}</h1>{BODY}</body></html>", [T, *ALL]),
    "no body tag": (BODY, ALL),
    "two paragraphs": (f"<body><p>{A}</p><p>{D}</p></body>", [A, D]),
    "div and paragraphs": (f"<body><div>{BODY}</div></body>", ALL),
    "nested divs": (f"<body><div><div><div>{BODY}</div></div></div></body>", ALL),
    "container and row": (f'<body><div class="container"><div class="row">{BODY}</div></div></body>', ALL),
    "id story": (f'<body>{NAV}<div id="story"><h1>{T}</h1>{BODY}</div>{FOOT}</body>', [T, *ALL]),
    "id main": (f'<body><div id="main">{BODY}</div></body>', ALL),
    "unknown class": (f'<body>{NAV}<div class="zq-x81">{BODY}</div>{FOOT}</body>', ALL),
    "one cell": (f"<body><table><tr><td>{BODY}</td></tr></table></body>", ALL),
    "centre and font": (f"<body><center><font size=2><p>{A}</p><p>{B}</p></font></center></body>", [A, B]),
    "heading and divs": (f"<body><h1>{T}</h1><div>{A}</div><div>{B}</div></body>", [T, A, B]),
    "divs as paragraphs": (f"<body>{NAV}<div><div>{A}</div><div>{B}</div><div>{C}</div></div>{FOOT}</body>", ALL),
    "breaks for paragraphs": (f"<body>{MENU}<div>{A}<br><br>{B}<br><br>{C}</div></body>", [f"{A} {B} {C}"]),
    "section": (f"<body><header><a href=/>The Paper</a></header><section><h2>{T}</h2>{BODY}</section>{FOOT}</body>", [T, *ALL]),
    "wrapped with menu and foot": (f'<body><div id="w1">{MENU}<div id="w2">{BODY}</div><div id="w3">&copy; 2020 The Paper</div></div></body>', ALL),
    "one long paragraph": (f"<body>{NAV}<p>{A} {B} {C} {D}</p>{FOOT}</body>", [f"{A} {B} {C} {D}"]),
    "columns": (f'<body><div class="container"><div class="row"><div class="col-md-8">{BODY}</div><div class="col-md-4"><h4>Most read</h4><ul><li><a href=/1>Storm ahead</a></li><li><a href=/2>Market falls</a></li></ul></div></div></div></body>', ALL),
    "list in the text": (f"<body><div><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul><p>{D}</p></div></body>", [A, B, C, D]),
    "quotation": (f"<body><div class=k2><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></div></body>", ALL),
    "subheadings": (f"<body><div class=text-9><h1>{T}</h1><p>{A}</p><h2>What comes next</h2><p>{B}</p><h2>Who is against it</h2><p>{C}</p></div></body>", [T, A, "What comes next", B, "Who is against it", C]),
    # what must go
    "comments of bare paragraphs": (f'<body><article>{BODY}</article><div class="comments"><p>I do not like it at all, and I never did.</p><p>You are wrong about this, my friend.</p></div></body>', ALL),
    "section of comments": (f'<body><article>{BODY}</article><section class="comments"><h3>Comments</h3><p>I do not like it at all.</p></section></body>', ALL),
    "comments within the article": (f'<body><article><h1>{T}</h1>{BODY}<section class="comments"><p>I do not like it at all, and I never did.</p><p>You are wrong about this.</p></section></article></body>', [T, *ALL]),
    "list of comments": (f'<body><main>{BODY}<div id="comments"><ol><li>I do not like it at all.</li><li>You are wrong about this, my friend.</li></ol></div></main></body>', ALL),
    "thread": (f'<body><article>{BODY}</article><div class="thread"><div class="post"><b>ann</b><p>I do not like it at all.</p></div><div class="post"><b>bob</b><p>You are wrong.</p></div></div></body>', ALL),
    "advert in the article": (f'<body><article><p>{A}</p><div class="advert">Buy two pairs of shoes and get a third for free this week only.</div><p>{B}</p><p>{C}</p></article></body>', ALL),
    "advert paragraph in the article": (f'<body><article><p>{A}</p><div class="ad-slot"><p>Buy two pairs of shoes and get a third for free.</p></div><p>{B}</p><p>{C}</p></article></body>', ALL),
    "sponsored box": (f'<body><div class="content">{BODY}<div class="sponsored"><h4>From our partners</h4><p>Ten ways to save on your bills this winter.</p></div></div></body>', ALL),
    "hidden attribute": (f"<body><article>{BODY}<div hidden><p>This is a draft that nobody should see, and that is not done.</p></div></article></body>", ALL),
    "display none": (f'<body><article><p>{A}</p><p style="display:none">This is a draft that nobody should see.</p><p>{B}</p><p>{C}</p></article></body>', ALL),
    "display none with spaces": (f'<body><div style="color: red; DISPLAY : none !important"><p>{D}</p></div><main>{BODY}</main></body>', ALL),
    "notice without a name": (f"<body><div><p>We use cookies to improve your visit to this site.</p><button>Accept</button><button>Refuse</button></div><article>{BODY}</article></body>", ALL),
    "notice at the end": (f'<body><article>{BODY}</article><div class="gdpr-x"><p>This site keeps data about your visit.</p><button>Fine</button></div></body>', ALL),
    "aside in the article": (f"<body><article><p>{A}</p><aside><h3>Read more</h3><ul><li><a href=/1>Storm ahead</a></li></ul></aside><p>{B}</p><p>{C}</p></article></body>", ALL),
    "side column of text": (f'<body><div class="main">{BODY}</div><div class="sidebar"><h3>About us</h3><p>We are a small paper in the north.</p></div></body>', ALL),
    "newsletter form": (f'<body><article>{BODY}</article><div class="newsletter"><p>Get our letter each morning.</p><form><input type=email><button>Join</button></form></div></body>', ALL),
    "login form": (f"<body><form action=/login><p>Please sign in to read more.</p><label>Name</label><input><label>Password</label><input></form><article>{BODY}</article></body>", ALL),
    "breadcrumbs and tags": (f'<body><div class="breadcrumb"><a href=/>Home</a> &rsaquo; <a href=/n>News</a></div><article>{BODY}</article><div class="tags"><a href=/t>town</a> <a href=/b>bridge</a></div></body>', ALL),
    "foot of text": (f'<body><div id="c">{BODY}</div><div id="footer"><p>The Paper is printed in the north. Write to us at any time.</p></div></body>', ALL),
    "script and style": (f"<body><script>var a = '<p>no</p>';</script><style>p {{ color: red }}</style><div>{BODY}</div><noscript>Turn on scripts.</noscript></body>", ALL),
    "entities": ("<body><div><p>Fish &amp; chips cost &pound;5 in 1990, and they cost &#8364;9 now, said one who &lt;still&gt; sells them by the harbour.</p><p>" + A + "</p></div></body>", ["Fish & chips cost £5 in 1990, and they cost €9 now, said one who <still> sells them by the harbour.", A]),
    # pages of nothing else
    "links alone": (f"<body>{NAV}{MENU}</body>", []),
    "nothing": ("<body></body>", []),
    "article with short lines": (f"<body>{NAV}<article><h1>{T}</h1><p>Yes.</p><p>{A}</p><p>No.</p></article>{FOOT}</body>", [T, "Yes.", A, "No."]),
    "figure": (f"<body><article><p>{A}</p><figure><img src=x><figcaption>The old bridge in winter</figcaption></figure><p>{B}</p></article></body>", [A, "The old bridge in winter", B]),
    "related after": (f'<body><main><h1>{T}</h1>{BODY}</main><section class="related"><h2>More</h2><p><a href=/1>Storm ahead</a></p><p><a href=/2>Market falls</a></p></section></body>', [T, *ALL]),
    "table layout with menu": (f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><p>{A}</p><p>{B}</p></td></tr></table></body>", [A, B]),
    "share buttons": (f'<body><article><h1>{T}</h1><div class="share"><a href=/f>Post</a> <a href=/t>Send</a></div>{BODY}</article></body>', [T, *ALL]),
}


#: Written after the training layouts, against the trained model.
LATER = {
    "disqus": (f"<body><main>{BODY}</main><div id=disqus_thread><p>I never liked it.</p><p>So what?</p></div></body>", ALL),
    "reactions": (f"<body><article>{BODY}</article><div class=reader-comments><p>I never liked it.</p></div></body>", ALL),
    "aside ad": (f"<body><article><p>{A}</p><aside class=ad>Buy shoes now, for less than ever.</aside><p>{B}</p><p>{C}</p></article></body>", ALL),
    "page div": (f"<body><div class=page><div class=top><a href=/>Home</a></div><div class=text><h1>{T}</h1>{BODY}</div></div></body>", [T,*ALL]),
    "td two": (f"<table><tr><td width=120><a href=/a>One</a><br><a href=/b>Two</a><br><a href=/c>Three</a></td><td><h2>{T}</h2><p>{A}</p><p>{B}</p></td></tr></table>", [T,A,B]),
    "font divs": (f"<body bgcolor=white><div align=center><font face=Arial>{A}</font></div><div align=center><font face=Arial>{B}</font></div></body>", [A,B]),
    "dl": (f"<body><h1>{T}</h1><dl><dt>Bridge</dt><dd>{A}</dd><dt>River</dt><dd>{B}</dd></dl></body>", [T,"Bridge",A,"River",B]),
    "short prose": (f"<body><p>{C}</p></body>", [C]),
    "many short": ("<body><article>"+"".join(f"<p>It was number {i}.</p>" for i in range(10))+"</article></body>", [f"It was number {i}." for i in range(10)]),
    "footer prose": (f"<body><article>{BODY}</article><footer><p>The Paper is a member of the press council, and keeps its rules.</p></footer></body>", ALL),
    "header h1": (f"<body><header><h1>The Paper</h1><p>News from the north</p></header><article><h1>{T}</h1>{BODY}</article></body>", [T,*ALL]),
    "menu ids": (f"<body><div id=nav><ul><li><a href=/>Home</a></li></ul></div><div id=content>{BODY}</div><div id=right><h3>Weather</h3><p>Rain in the north.</p></div></body>", ALL),
    "form inside": (f"<body><article><p>{A}</p><form><p>Get our letter.</p><input><button>Go</button></form><p>{B}</p><p>{C}</p></article></body>", ALL),
    "banner": (f"<body><div class=banner>Sale: all books at half price until Friday.</div><article>{BODY}</article></body>", ALL),
    "cookie": (f"<body><div class=cookies><p>We use cookies.</p></div><article>{BODY}</article></body>", ALL),
    "unknown notice": (f"<body><div class=zzz><span>This site uses cookies to work.</span><button>OK</button></div><div><p>{A}</p><p>{B}</p></div></body>", [A,B]),
    "span paragraphs": (f"<body><div class=b><span>{A}</span><br><span>{B}</span></div></body>", [f"{A} {B}"]),
    "pre": (f"<body><h1>{T}</h1><pre>{A}\n{B}</pre></body>", [T,f"{A} {B}"]),
    "links in prose": (f"<body>{NAV}<div><p>{A} <a href=/x>See here</a> and <a href=/y>there</a>. {B}</p><p>{C}</p></div></body>", [f"{A} See here and there. {B}",C]),
}


@pytest.mark.parametrize("name", [*PAGES, *LATER])
def test_pages(name):
    page, expected = (PAGES | LATER)[name]
    assert html.main_text(page, html.default_model()) == "\n".join(expected)
