"""Labelled pages: (html, main text). Written by hand for this library; the extractor's weights are learnt from them."""

LABELLED = [
    (
        '<!DOCTYPE html><html><head><title>Rivers in spring</title><style>p{margin:0}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>'
        '<div class="ad">Buy new boots today.</div><article><h1>Rivers in spring</h1><p>When the snow melts the rivers rise, and the fields along them lie under water for a week or two.</p>'
        "<p>Farmers move their cattle to the hills and wait.</p><p>Later the mud makes the best soil of the whole valley.</p></article><p>Share this page with your friends, or print it.</p><footer>&copy; 2020 valley.example &middot; All rights reserved.</footer></body></html>",
        "Rivers in spring\nWhen the snow melts the rivers rise, and the fields along them lie under water for a week or two.\nFarmers move their cattle to the hills and wait.\nLater the mud makes the best soil of the whole valley.",
    ),
    (
        '<html><body><header><h2>Town Paper</h2><p>Every day since 1901</p></header><div id="content"><h1>A bridge is built</h1><p>The old bridge could no longer carry the trucks that bring stone from the quarry.'
        '<p>Its successor is twice as wide and has a path for walkers.</p><aside class="related"><h3>Read also</h3><p>Ten bridges you must see</p></aside><p>It opens in May.</p></div>'
        '<div class="comments"><p>Great news, says a reader.</p><p>Too expensive, says another.</p></div><form><p>Leave a reply</p><input name="x"><button>Send</button></form></body></html>',
        "A bridge is built\nThe old bridge could no longer carry the trucks that bring stone from the quarry.\nIts successor is twice as wide and has a path for walkers.\nIt opens in May.",
    ),
    (
        '<html><head><script>var t="</p>";</script></head><body><div class="cookie-banner"><p>We use cookies to make this site better.</p></div><ul class="menu"><li><a href="/1">One</a><li><a href="/2">Two</a></ul>'
        "<p>You are here: Home, Kitchen, Bread</p><main><h1>On baking bread</h1><p>Flour, water, salt and time: more is not needed, <b>but the time</b> is.<br>Let it rest over night.</p><ul><li>500 grams of flour</li><li>350 grams of water</li></ul>"
        '<p>Bake it hot.</p></main><div class="sidebar"><p>Popular: soups, pies, cakes</p></div><footer><p>Contact us</p></footer></body></html>',
        "On baking bread\nFlour, water, salt and time: more is not needed, but the time is. Let it rest over night.\n500 grams of flour\n350 grams of water\nBake it hot.",
    ),
    (
        "<html><body><table><tr><td><a href='/x'>Start</a></td><td><a href='/y'>Index</a></td></tr></table><div><p>A page without any names for its parts still has paragraphs, and they are long enough to be told from the links around them.</p>"
        "<p>That is all that a scan over words and tags needs.</p></div><div class='footer'><a href='/p'>Privacy</a> <a href='/t'>Terms</a></div></body></html>",
        "A page without any names for its parts still has paragraphs, and they are long enough to be told from the links around them.\nThat is all that a scan over words and tags needs.",
    ),
]

#: Parts of pages, labelled by hand: what opens them, and what they say. No article text:
SIDE_PARTS = [
    ("<nav>", "Home News Sport About us"), ('<ul class="menu">', "Start Shop Service"), ('<div id="navbar">', "Topics A to Z"), ('<div class="navigation nav">', "Next chapter Previous chapter"), ('<ol class="breadcrumb">', "Home Garden Tools"), ('<div class="breadcrumbs">', "You are here Home Garden"),
    ('<div class="pagination">', "Page 1 2 3 4"), ('<span class="pager">', "older newer"), ("<header>", "The Valley Herald since 1901"), ('<div class="header">', "Your town and its news"), ('<div id="masthead">', "Weekly paper of the coast"), ('<div class="banner">', "Summer sale this week"), ("<footer>", "Imprint and contact"), ('<div id="footer">', "Made in the valley"),
    ('<p class="copyright">', "All rights reserved 2021"), ("<aside>", "Most read today"), ('<div class="sidebar">', "Popular soups pies and cakes"), ('<div class="side aside">', "Weather today"), ('<div class="widget">', "Join the club"), ('<div class="related">', "Ten bridges you must see"), ('<div class="recommended">', "More for you"), ('<div class="toolbar">', "Print Save Send"),
    ('<div class="ad">', "Buy new boots today"), ('<div class="ads">', "Two for one"), ('<div class="advert">', "Try our soap"), ('<div class="adverts">', "Cars of the year"), ('<div class="advertisement">', "The best phone ever"), ('<div class="sponsored">', "Paid by a bank"), ('<div class="sponsor">', "Our partner"), ('<div class="promo">', "Get a month free"), ('<div class="promotion">', "Half price until Sunday"),
    ('<div class="cookie">', "We use cookies"), ('<div class="cookies">', "Accept all cookies"), ('<div class="consent gdpr">', "Choose what we may store"), ('<div class="notice">', "This site moves in May"), ('<div class="notices">', "Server work tonight"), ('<div class="alert">', "Storm warning for the coast"), ('<div class="popup">', "Wait before you go"), ('<div class="modal">', "Close this window"), ("<dialog>", "Do you agree"),
    ('<div class="newsletter">', "Get our letter every week"), ('<div class="subscribe">', "Subscribe now"), ('<div class="signup">', "Create an account"), ('<div class="login">', "Name and password"), ('<div class="search">', "Search the archive"), ("<form>", "Send us a message"), ('<div class="form">', "Your mail address"), ("<button>", "Send"), ("<label>", "First name"), ("<menu>", "Copy Paste"),
    ('<div class="share">', "Share this page"), ('<div class="sharing">', "Tell a friend"), ('<div class="social">', "Follow us everywhere"), ('<div class="comment">', "Great news says a reader"), ('<div class="comments">', "Too expensive says another"), ('<div class="reply">', "I agree with you"), ('<div class="replies">', "Three answers"), ('<div id="disqus">', "Join the talk"),
    ('<div role="complementary">', "See also"), ('<div role="contentinfo">', "About this site"), ('<div class="hidden">', "Old text nobody sees"),
]
#: What opens the part that holds the article.
MAIN_PARTS = ["<article>", '<div class="content">', "<main>", '<div id="post">', '<div class="entry">', '<div class="story">', '<section class="body">', '<div class="text">', '<div id="main">', '<div class="article">']
_STORY = [
    "When the snow melts the rivers rise and the fields along them lie under water for a week or two.", "The old bridge could no longer carry the trucks that bring stone from the quarry above the town.", "Flour and water and salt and time are all that a good loaf needs, but the time is the hard part.",
    "Nobody had opened the attic since the war, so the letters lay there as they had been left.", "Bees find their way back by the sun, and on dull days by what they remember of the hedges.",
]


def _close(opened: str) -> str:
    return f"</{opened[1:].split()[0].rstrip('>')}>"


def _page(k: int) -> tuple[str, str]:
    """A page of the parts above: some before the article, one inside it, some behind; its main text is the story."""
    n, story = len(MAIN_PARTS), [_STORY[(k + j) % len(_STORY)] for j in range(3)]
    sides = [f"{o}{t}{_close(o)}" for o, t in SIDE_PARTS[k::n]]
    opened, middle = MAIN_PARTS[k], len(sides) // 2
    inner = f"<p>{story[0]}</p><p>{story[1]}</p>{sides[middle]}<p>{story[2]}</p>"
    return f"<html><body>{''.join(sides[:middle])}{opened}{inner}{_close(opened)}{''.join(sides[middle + 1 :])}</body></html>", "\n".join(story)


LABELLED += [_page(k) for k in range(len(MAIN_PARTS))]
