"""Pages made by hand, with the main region between two marking comments; the weights are fitted on them."""

_STORY = (
    "The council met on Tuesday evening to discuss the new bridge over the river. Members spoke for two hours about cost, traffic and the old trees along the bank.",
    "Work is due to begin in spring, once the water has gone down. Until then the ferry keeps its winter hours, with one boat every forty minutes.",
    "People who live near the landing place welcomed the plan, though some of them asked for a wider path and better lights.",
    "A second meeting will be held next month. The plans can be seen in the library until the end of the week.",
)
_LINKS = ("Home", "News", "Sport", "Weather", "About us", "Contact")


def _paragraphs(n: int) -> str:
    return "".join(f"<p>{x}</p>" for x in _STORY[:n])


def _list(tag: str = "ul") -> str:
    return f"<{tag}>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(_LINKS)) + f"</{tag}>"


PAGES = [
    # an article element, the usual parts around it
    f'<!DOCTYPE html><html lang="en"><head><title>Bridge</title><style>p{{margin:0}}</style></head><body><nav>{_list()}</nav><div class="ad">Buy two, pay for one.</div><article><!--[--><h1>New bridge</h1>{_paragraphs(4)}<!--]--></article><footer>&copy; The Paper</footer></body></html>',
    # no article element; links and short lines in plain divisions
    f"<html><body><div>{_list()}</div><div>Tuesday | Late edition</div><div><!--[--><h1>New bridge</h1>{_paragraphs(3)}<!--]--></div><div><a href='/a'>Older</a> <a href='/b'>Newer</a></div><div>All rights reserved</div></body></html>",
    # layout by tables
    f"<html><body><table><tr><td><a href='/'>Start</a><br><a href='/x'>Shop</a><br><a href='/y'>Help</a></td><td><!--[--><h2>New bridge</h2>{_paragraphs(4)}<!--]--></td></tr></table><center>Made by hand</center></body></html>",
    # unclosed tags, emphasis and links within the text
    "<body><div><a href='/'>Start</a> | <a href='/n'>News</a></div><main><!--[--><h1>New bridge</h1><p><b>" + _STORY[0] + "<br><p>" + _STORY[1] + " <a href='/plan'>See the plan</a> for <em>all</em> of it.<p>" + _STORY[2] + "<ul><li>" + _STORY[3] + "</li></ul><!--]--></main><div>Share this page</div>",
    # text outside of the article that is not part of it
    f"<body><div>You read one of three free pages this month.</div><div><span>Tuesday</span></div><article><!--[--><h1>New bridge</h1><section>{_paragraphs(4)}</section><blockquote>{_STORY[2]}</blockquote><!--]--></article><div><h3>More</h3><p><a href='/q'>The mill</a></p><p><a href='/r'>The market</a></p></div><div>Printed in town</div></body>",
    # a short text
    f"<html><body><nav>{_list()}</nav><article><!--[--><h1>Ferry</h1><p>{_STORY[1]}</p><!--]--></article><footer>Imprint</footer></body></html>",
    # a journal of nested divisions without telling names: a strip of links, a column of teasers, a closing line
    f'<body><div class="k1"><div>{_list()}</div><div>Signed in as guest</div></div><div class="k2"><div class="k3"><!--[--><h1>New bridge</h1><div>{_paragraphs(4)}</div><h2>What comes next</h2>{_paragraphs(2)}<!--]--></div><div class="k4"><h4>More</h4>{_list()}<div>Open daily</div></div></div><div class="k5">Printed in town <a href="/i">Imprint</a> <a href="/t">Terms</a></div></body>',
    # instructions: short items belong to the text
    f'<body><div>{_list("ol")}</div><div><!--[--><h1>Ferry bread</h1><p>{_STORY[1]}</p><ul><li>two cups of flour</li><li>one cup of water</li><li>salt and some honey</li></ul><p>{_STORY[0]}</p><ol><li>Mix flour and water</li><li>Let it rest for an hour</li></ol><p>{_STORY[2]}</p><!--]--></div><div><a href="/p">Print</a> or <a href="/m">mail</a> it</div></body>',
    # one division with everything in it
    f"<body><div><a href='/'>Start</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><div>Late edition</div><!--[--><h1>New bridge</h1>{_paragraphs(4)}<!--]--><div>Ask for a copy</div><div>Page two</div>{_list()}</body>",
    # text in divisions and spans instead of paragraphs, lines of facts around it
    f"<body><section><div>Reading time: four minutes</div><div>Tuesday</div></section><section><!--[-->" + "".join(f"<div><span>{x}</span></div>" for x in _STORY) + f"<!--]--></section><section><div>Seen by 2,040 readers</div><div><a href='/l'>Like</a></div>{_list()}</section></body>",
]
