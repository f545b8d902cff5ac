"""Text functions as JVM expressions: titles, terms, tokens, numbers, sentences, cleaning and citation lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function words that overlap scoring leaves out.
STOP_WORDS = (
    "a an and are as at be but by can could did do does for from had has have how i if in into is it its "
    "me my of on or our so than that the their them then there these they this those to was we were what "
    "when where which who whom why will with would you your about tell explain describe much many"
).split()
STEM = 6
# Section names that hold no prose.
SKIPPED_SECTIONS = ("see also", "references", "external links", "further reading", "notes", "related pages", "other websites", "sources", "bibliography", "citations", "footnotes", "gallery", "notes and references")
# Fixed value: where one sentence of an article ends and the next begins.
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"


def squash(c: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_title(c: Column) -> Column:
    """The key of a title: underscores are spaces, one space between words, lower case."""
    return F.lower(squash(F.translate(c, "_", " ")))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(c: Column) -> Column:
    """Content words cut to six letters, in order, for overlap scoring."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(tokens(c), lambda w: ~F.array_contains(stop, w)), lambda w: F.substring(w, 1, STEM))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")


def token_cost(c: Column) -> Column:
    """About four bytes for a token, and one token for each digit."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return (F.ceil((F.octet_length(c) - digits) / 4) + digits).cast("long")


def numbers(c: Column) -> Column:
    """Numbers as written, without commas; single digits without decimals are counts or list marks and drop out."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}])([0-9](?:[0-9]|[.,](?=[0-9]))*)"), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))), lambda x: (F.length(x) >= 2) | x.contains("."))


def sentences(c: Column) -> Column:
    """Chunker sentences: a break after . ! ? and white space before a capital, digit or opening mark."""
    return F.filter(F.split(c, SENTENCE_BREAK), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def first_sentence(c: Column) -> Column:
    flat = F.translate(c, "\n", " ")
    return F.substring(F.coalesce(F.get(sentences(flat), F.lit(0)), c), 1, 300)


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, their lines trimmed and joined by a space."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+"), squash), lambda p: p != "")


def strip_html(c: Column) -> Column:
    """Tags out: block ends make a blank line, breaks and items a line; the five named entities are resolved."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|ul|ol|table|tr|section|article)\s*>", "\n\n")
    c = F.regexp_replace(c, r"(?i)<(br|li)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "")


def strip_markdown(c: Column) -> Column:
    """Emphasis, code marks and backslash escapes out; one line."""
    c = F.regexp_replace(c, r"(\*\*|__|\*|`)", "")
    return squash(F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+.!-])", "$1"))


def licence_name(c: Column) -> Column:
    """"CC BY-SA 4.0" from a licence link; else the text without links, or "not stated"."""
    kind = F.regexp_extract(c, r"creativecommons\.org/(?:licenses|publicdomain)/([a-z-]+)/(\d\.\d)", 1)
    version = F.regexp_extract(c, r"creativecommons\.org/(?:licenses|publicdomain)/([a-z-]+)/(\d\.\d)", 2)
    name = F.when(kind == "zero", "CC0").when(kind == "mark", "Public Domain Mark").otherwise(F.concat(F.lit("CC "), F.upper(kind)))
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*-?\s*https?://\S+", ""))
    return F.when(kind != "", F.concat_ws(" ", name, version)).when(plain != "", plain).otherwise("not stated")


# The address of a page in each kind of pack; {t} is its escaped name, {s} the set before ": " in its title.
_WIKIS = {"wikipedia": "en.wikipedia.org", "enwiki": "en.wikipedia.org", "wiktionary": "en.wiktionary.org", "wiktionary-en": "en.wiktionary.org", "wikibooks-en": "en.wikibooks.org", "wikiversity-en": "en.wikiversity.org", "wikivoyage-en": "en.wikivoyage.org", "wikiquote-en": "en.wikiquote.org", "wikem-en": "wikem.org"}
PAGE_FORMS = {pack: f"https://{host}/wiki/{{t}}" for pack, host in _WIKIS.items()} | {"archwiki-en": "https://wiki.archlinux.org/title/{t}", "arxiv": "https://arxiv.org/abs/{t}", "arxiv-abs": "https://arxiv.org/abs/{t}", "cdc-travel": "https://wwwnc.cdc.gov/{t}", "medlineplus": "https://medlineplus.gov/{t}.html", "stackexchange": "https://{t}", "devdocs-en": "https://devdocs.io/{s}/{t}"}
_ESCAPED = {"%": "%25", " ": "_", "?": "%3F", "#": "%23"}  # in this order


def page_url(pack: Column, title: Column, url_title: Column) -> Column:
    """The page of an article, by the pack's URL form, or the page name itself if it is an address. Null for packs without pages, for unknown or
    empty page names, and where a title lacks the set that its form needs."""
    name = F.coalesce(url_title, F.lit(""))
    escaped = name
    for a, b in _ESCAPED.items():
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    form = F.create_map(*[F.lit(x) for kv in PAGE_FORMS.items() for x in kv])[pack]
    needs_set = form.contains("{s}") & ~F.coalesce(title, F.lit("")).contains(": ")
    filled = F.replace(F.replace(form, F.lit("{s}"), F.lower(F.substring_index(F.coalesce(title, F.lit("")), ": ", 1))), F.lit("{t}"), escaped)
    return F.when((name == "") | name.contains("__unknown__"), None).when(name.rlike("^https?://"), name).when(~needs_set, filled)


def url_page(url: Column) -> Column:
    """struct<pack, title> of the page that a URL opens; null where no pack holds it."""
    host = F.regexp_replace(F.parse_url(url, F.lit("HOST")), r"^www\.", "")
    path = F.url_decode(F.replace(F.parse_url(url, F.lit("PATH")), F.lit("+"), F.lit("%2B")))
    wiki = F.when(host == "en.wikipedia.org", "wikipedia").when(host == "en.wiktionary.org", "wiktionary").when(host == "en.wikivoyage.org", "wikivoyage").when(host == "en.wikiquote.org", "wikiquote")
    paper = F.regexp_extract(path, r"^/(?:abs|pdf)/([^v]+?)(?:v\d+)?(?:\.pdf)?$", 1)
    question = F.regexp_extract(path, r"^/(?:questions|q)/(\d+)", 1)
    return (
        F.when(wiki.isNotNull() & path.startswith("/wiki/"), F.struct(wiki.alias("pack"), F.translate(F.substring(path, 7, 1 << 20), "_", " ").alias("title")))
        .when((host == "arxiv.org") & (paper != ""), F.struct(F.lit("arxiv").alias("pack"), paper.alias("title")))
        .when((host == "medlineplus.gov") & path.endswith(".html"), F.struct(F.lit("medlineplus").alias("pack"), F.regexp_extract(path, r"^/(.*)\.html$", 1).alias("title")))
        .when(host.endswith(".stackexchange.com") & (question != ""), F.struct(F.lit("stackexchange").alias("pack"), F.concat(host, F.lit("/questions/"), question).alias("title")))
    )


def format_number(x: Column) -> Column:
    """Thousands separated; whole numbers without decimals, others with four, or three significant digits where that shows nothing."""
    places = F.when(F.abs(x) < 0.001, F.greatest(F.lit(4), (2 - F.floor(F.log10(F.abs(x)))).cast("int"))).otherwise(4)
    fixed = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.regexp_replace(F.format_number(x, 0), ",", ""))
    for n in range(4, 16):
        fixed = fixed.when(places == n, F.regexp_replace(F.regexp_replace(F.format_string(f"%.{n}f", x), "0+$", ""), r"\.$", ""))
    whole, frac = F.regexp_extract(fixed, r"^(-?\d+)", 1), F.regexp_extract(fixed, r"(\.\d+)$", 1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.when((x != 0) & (F.abs(x) < 1e-12), F.format_string("%.2e", x)).otherwise(F.concat(grouped, frac))


def coordinates(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f°%s, %.4f°%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def content_id(title: Column, pages: Column) -> Column:
    """"doc-" and ten hex digits over title and pages, separated by NUL."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(title, F.lit("\0"), F.array_join(pages, "\0")), 256), 1, 10))


def text_hash(c: Column) -> Column:
    return F.xxhash64(c)


def normalize_answer(c: Column) -> Column:
    """Lower case, punctuation to spaces, padded by one space at both ends, so that contains() meets whole words."""
    return F.concat(F.lit(" "), squash(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")), F.lit(" "))


def search_query(c: Column) -> Column:
    """Letters and digits only, without the operators AND, OR and NOT."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]", " "), r"\s+"), lambda w: (w != "") & ~w.isin("AND", "OR", "NOT"))
    return F.array_join(words, " ")


def rerank_text(title: Column, section: Column, text: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) == "", F.concat(title, F.lit(": "), text)).otherwise(F.concat(title, F.lit(" — "), section, F.lit(": "), text))


def fact_line(entity: Column, label: Column, value: Column, when: Column) -> Column:
    return F.concat(F.concat_ws("", entity, F.lit(" — "), label, F.lit(": "), value), F.when(when.isNotNull(), F.concat(F.lit(" ("), when, F.lit(")"))).otherwise(""))


def snippet(c: Column, n: int = 160) -> Column:
    return F.substring(c, 1, n)


def split_thinking(c: Column) -> Column:
    """struct<thinking, answer>: what stands in <think>…</think>, and the rest."""
    return F.struct(F.trim(F.regexp_extract(c, r"(?s)<think>(.*?)(?:</think>|$)", 1)).alias("thinking"), F.trim(F.regexp_replace(c, r"(?s)<think>.*?(?:</think>|$)", "")).alias("answer"))


def complete_part(c: Column) -> Column:
    """An answer without its unfinished last sentence; unchanged where no sentence is finished."""
    cut = F.regexp_extract(c, r"(?s)^(.*[.!?][\"')\]]*)", 1)
    return F.when(cut != "", cut).otherwise(c)


def tidy(c: Column) -> Column:
    """LaTeX marks and the label of computed lines out."""
    c = F.regexp_replace(c, r"\\\(|\\\)|\\\[|\\\]|\$\$?", "")
    c = F.regexp_replace(c, r"\\(?:text|mathrm)\{([^}]*)\}", "$1")
    c = F.replace(F.replace(c, F.lit("\\times"), F.lit("×")), F.lit("\\cdot"), F.lit("·"))
    return F.regexp_replace(c, r"(?m)^\s*COMPUTED:\s*", "")


def strip_echo(answer: Column, question: Column) -> Column:
    """An answer without the question repeated before it."""
    q = F.concat(F.regexp_replace(squash(question), r"[?.! ]+$", ""))
    return F.when(F.lower(answer).startswith(F.lower(q)), F.regexp_replace(F.substr(answer, F.length(q) + 1), r"^[\s?:.!-]+", "")).otherwise(answer)


def answer_found(answer: Column, expected: Column, n_sentences: int = 3) -> Column:
    """Whether any of the expected strings is in the first sentences of an answer, in any case."""
    head = F.lower(F.array_join(F.slice(sentences(answer), 1, n_sentences), " "))
    return F.exists(expected, lambda e: head.contains(F.lower(e)))


def number_found(answer: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """Whether a number of the answer, with its scale word, is within a relative tolerance of the expected one."""
    raw = F.regexp_extract_all(answer, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?(?:\s+(?:thousand|million|billion))?)"), 1)

    def value(x: Column) -> Column:
        scale = F.when(x.contains("thousand"), 1e3).when(x.contains("million"), 1e6).when(x.contains("billion"), 1e9).otherwise(1.0)
        return F.regexp_replace(F.regexp_extract(x, r"^([0-9,.]+)", 1), ",", "").try_cast("double") * scale

    return F.exists(raw, lambda x: F.abs(value(x) - expected) <= tolerance * F.abs(expected))


def today() -> Column:
    """The session's date as text, year first."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")
