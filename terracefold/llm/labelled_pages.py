"""Labelled pages from which html_text learns its weights, made by hand.

A number stands for as many words. `keep` marks elements that are content, `drop` parts of them that are not; all other
text is no content. The marks are no features.
"""

from __future__ import annotations

#: Fixed list: names in class, id and role attributes that set parts of a page apart.
APART = ["ad", "ads", "advert", "advertisement", "alert", "banner", "breadcrumb", "byline", "comment", "complementary", "consent", "contentinfo", "cookie", "copyright", "discussion", "disqus", "footer", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "outbrain", "pager", "pagination", "paywall", "popup", "promo", "reaction", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "tags", "toolbar", "topbar", "widget"]
#: Fixed list: names of elements that hold the content.
AROUND = ["article", "body", "content", "entry", "main", "page", "post", "story", "text"]
#: Fixed list: names of whole-page wrappers; they say nothing, whatever words they are made of.
WRAPPERS = ["wrapper", "container", "app", "site", "layout has-sidebar", "page header-fixed", "search-app", "no-comments", "with-menu", "footer-sticky", "banner-page", "nav-open"]

PAGES = [
    "<div>4</div><h1 keep>8</h1><p keep>60 <b>3</b> 20 <a>4</a> 10</p><p keep>2</p><ul keep><li>9</li><li>12</li></ul>",
    "<nav><ul><li><a>2</a></li><li><a>1</a></li></ul></nav><article keep><h1>9</h1><p>80 <a>3</a> 20</p><p>30<br>10</p><p>2</p><blockquote>15</blockquote></article><footer>12</footer>",
    "<header><a>3</a><h1>4</h1></header><nav><a>2</a></nav><main keep><header><h1>8</h1><p>12</p></header><h2>5</h2><p>50</p><table><tr><td>3</td><th>2</th></tr></table><pre>30</pre><aside drop><p>40</p></aside><p>25</p><nav drop><a>6</a></nav></main><aside><p>30</p><ul><li><a>3</a></li></ul></aside><footer><p>10</p></footer>",
    "<header><div>5</div></header><article keep><h1>6</h1><figure><figcaption>8</figcaption></figure><p>40</p><form drop><label>4</label><p>6</p><button>2</button><select><option>1</option></select></form><p>30 <em>2</em></p><footer drop><p>8</p><a>3</a></footer></article><form><label>3</label><input></form><p>12</p><div>20</div>",
    "<body keep>30 <b>4</b> 10<p>12</p></body>",
    "<div keep>45<br>20 <i>2</i></div><div><a>2</a> <a>2</a> <a>1</a></div>",
    "<div><a>1</a> <a>1</a> <a>2</a> <a>1</a></div><div keep><h2>4</h2><div>60</div><div>30 <a>2</a> 8</div><dl><dt>3</dt><dd>12</dd></dl></div><ul><li><a>3</a></li><li><a>2</a></li></ul>",
    "<main keep><article><h2>6</h2><p>40</p></article><article><h2>5</h2><p>35</p></article><section><h3>3</h3><p>20</p></section></main><section><h3>3</h3><p>8</p><a>5</a></section>",
    "<article keep><p>50</p><section><h2>3</h2><p>30</p><ol><li>10</li></ol></section><details><summary>3</summary><p>10</p></details></article><dialog><p>20</p><button>2</button></dialog><menu><li>2</li></menu>",
    "<table><tr><td><a>2</a></td><td keep><p>50</p><p>20</p>30</td></tr></table>",
    "<x:note>copyright</x:note><div keep><p>20</p></div><div>&copy; 5</div><p>&copy; 4</p>",
    "<article keep><header><h1>7</h1><p>10</p></header><p>30</p></article><header><p>9</p></header>",
    "<p>10</p><ul><li>3</li><li><a>2</a></li></ul><article keep><h1><a>7</a></h1><section><h2>3</h2><p>30</p><div>20 <a>5</a></div></section><ul><li><a>4</a></li><li>12</li></ul><div><a>3</a></div><section><div>25</div></section></article><div><h3>2</h3><p>25</p><ul><li>4</li></ul></div><p>30</p>",
    "<h2>3</h2><div>30</div><main keep><section><h2>3</h2><p>30</p><ul><li><a>4</a> 6</li></ul></section><div><p>20</p><div>9</div></div></main><section><h2>4</h2><p>40</p></section><h3>4</h3>20",
    "<section keep><h1>4</h1><p>50</p><section><h2>2</h2><p>30</p></section></section><section class='related'><h2>2</h2><a>4</a></section>",
    "<div keep><section><p>40</p><div>12</div></section><section><h3>3</h3><p>10 <a>3</a></p></section></div>",
]


def pages() -> list[str]:
    """PAGES, and for each name of the lists a page that uses it."""
    out = list(PAGES)
    for k, name in enumerate(APART):
        tag = ("div", "section", "ul", "p")[k % 4]
        part = f'<{tag} class="{name}">6</{tag}>'
        inner = f'<div id="{name}"><h3>2</h3><p>20</p><ul><li>6</li></ul></div><section class="{name}"><article class="{name}"><p>15</p></article></section>'
        out.append(f"{part}<article keep><h1>5</h1><p>30</p><div drop class='{name}'><p>18</p><div>5</div></div><p>20</p><section drop id='{name}s'><h2>2</h2><p>25</p></section><section><h2>3</h2><p>20</p></section></article>{inner}<p>12</p><div>9</div>")
        out.append(f"{part}<div keep><h1>5</h1><p>30</p></div><div class='site-{name}'><p>12</p>4</div>{inner}")
    for k, name in enumerate(AROUND):
        out.append(f'<div>3</div><div keep class="{name}"><p>30</p>20<p drop class="{APART[-1 - k]}">6</p><div>15</div><div drop class="{APART[9 + k]}"><p>20</p></div></div><div><a>4</a></div>')
        out.append(f'<div id="{name}-{APART[k]}"><p>5</p></div><div keep id="{name}"><div class="{name}-header"><h1>6</h1></div><div>40</div></div>')
    for name in WRAPPERS:
        out.append(f'<div class="{name}"><nav><a>3</a></nav><article keep><h1>6</h1><p>40</p><div>20</div></article><div>6</div></div>')
        out.append(f'<div id="{name}"><div keep><div class="entry-header"><h1>6</h1></div><p>40</p></div><footer>6</footer></div>')
    return out
