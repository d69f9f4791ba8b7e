"""Web pages as files: a URL's path and an article's text, as column expressions.

The path is the host in lower case and the URL's path; scheme, query and fragment are left out. As in relative references, what follows the last
slash is the file, so a URL that ends in a slash is the file without a name of that folder.

The text is what stands from the first article's start to the last one's end, on a page without any the whole page, in lower case.
Comments, scripts and styles are left out, those that never end to the end of the text. Inline tags are dropped and other tags end lines;
line feeds of the source and character references are spaces. A tag is what stands between ``<`` and the next ``>``, without another ``<``.
Each pattern goes over a text once, however it is broken.
"""

from __future__ import annotations

from pyspark.sql import functions as F

INLINE = "a|abbr|b|big|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var"
#: Patterns and what they become, in this order.
REPLACED = [
    (r"(?s)<!--.*?(-->|\z)", ""),
    (r"(?s)<script[\x20\t\n\f\r/>].*?(</script|\z)", "<"),
    (r"(?s)<style[\x20\t\n\f\r/>].*?(</style|\z)", "<"),
    (r"[\t\n\f\r]", " "),
    (rf"</?({INLINE})([\x20/][^<>]*)?>", ""),
    (r"<[^<>]*>", "\n"),
    (r"&(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);", " "),
]
BEFORE, ARTICLE = r"(?s)^.*?(<article[\x20\t\n\f\r/>])", r"(?s)^(.*)</article"


def page_path(url):
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(bare, "(?s)/.*$", 0)
    return F.concat(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), F.when(path == "", "/").otherwise(path))


def page_text(html):
    text = F.regexp_replace(F.lower(html), BEFORE, "$1")
    article = F.regexp_extract(text, ARTICLE, 1)
    text = F.when(article == "", text).otherwise(article)
    for pattern, by in REPLACED:
        text = F.regexp_replace(text, pattern, by)
    return text
