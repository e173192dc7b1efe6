"""Column functions that turn signals into scores and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import lookups
from factloom.functions import text


def suffixes(host: Column) -> Column:
    """The host and all domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def listed(tops: Column, domains: list[str]) -> Column:
    """Whether one of a host's suffixes is one of the domains (a set of fixed size)."""
    return F.exists(tops, lambda d: d.isin(*domains))


def suffix_of(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    return listed(suffixes(host), domains)


def first_match(cases: list[tuple[Column, float]], otherwise: float) -> Column:
    out = F
    for test, value in cases:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(otherwise))


_NAMES = list(dict.fromkeys(d for d, _ in lookups.DOMAIN_TRUST))
_TRUST = [dict(reversed(lookups.DOMAIN_TRUST))[d] for d in _NAMES]


def host_trust(h: Column, tops: Column) -> Column:
    """Trust in a host with these suffixes: the first listed domain, else rules, else 0.5."""
    names, values = F.array(*[F.lit(d) for d in _NAMES]), F.array(*[F.lit(float(w)) for w in _TRUST])
    place = F.array_min(F.filter(F.transform(tops, lambda d: F.array_position(names, d)), lambda i: i > 0))
    return trust_of(h, F.get(values, place.cast("int") - 1))


def trust_of(h: Column, found: Column) -> Column:
    """Trust in a host for which the lists say ``found`` (null: nothing)."""
    rules = [(h.endswith(".gov") | h.endswith(".gov.br"), 0.95), (h.endswith(".edu") | h.endswith(".edu.br") | h.contains(".ac."), 0.9), (h.rlike(lookups.UNIVERSITY), 0.9)]
    return F.when(h == "", F.lit(0.5)).otherwise(F.coalesce(found, first_match(rules, 0.5)))


def domain_trust(url: Column) -> Column:
    """Trust in a URL's domain; 0.5 when unknown or empty."""
    h = text.host(url)
    return host_trust(h, suffixes(h))


#: The lists of domains besides trust, by name.
LISTS = {
    "social": lookups.SOCIAL_DOMAINS,
    "wiki": lookups.WIKI_DOMAINS,
    "video": lookups.VIDEO_DOMAINS,
    "forum": lookups.FORUM_DOMAINS,
    "blog": lookups.BLOG_DOMAINS,
    "news": lookups.NEWS_DOMAINS,
    "press": lookups.PRESS_DOMAINS,
}


def social_host(tops: Column, publisher: Column) -> Column:
    return social_of(listed(tops, LISTS["social"]), publisher)


def social_of(on_list: Column, publisher: Column) -> Column:
    """Whether a source is a social one: its host is on the list, or a word of its publisher."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(publisher, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return on_list | F.exists(words, lambda w: w.isin(*lookups.SOCIAL_PUBLISHERS))


def is_social(url: Column, publisher: Column) -> Column:
    return social_host(suffixes(text.host(url)), publisher)


def rating_score(rating: Column) -> Column:
    """Exact rating first, then the first rating contained in it, else 0.5."""
    r = F.lower(text.stripped(rating))
    exact = [(r == k, v) for k, v in lookups.RATINGS]
    inside = [(r.contains(k), v) for k, v in lookups.RATINGS]
    return first_match([(F.coalesce(r, F.lit("")) == "", 0.5), *exact, *inside], 0.5)


def source_tags(url: Column, publisher: Column, rating: Column) -> Column:
    """Sorted tags of a source."""
    h = text.host(url)
    return host_tags(h, suffixes(h), url, publisher, rating)


def host_tags(h: Column, tops: Column, url: Column, publisher: Column, rating: Column) -> Column:
    return tags_of(h, lambda name: listed(tops, LISTS[name]), url, publisher, rating)


def tags_of(h: Column, on: Callable[[str], Column], url: Column, publisher: Column, rating: Column) -> Column:
    """Sorted tags of a source; ``on`` says whether its host is below a domain of a list."""
    pub = F.lower(text.stripped(F.coalesce(publisher, F.lit(""))))
    low, rate = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(rating, F.lit("")))
    some = h != ""
    below = lambda name: some & on(name)
    has = lambda c, *words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    checked = has(low, *lookups.FACT_CHECK_DOMAINS)
    rules = [
        ("fact-check", has(rate, "fact-check") | rate.isin([k for k, _ in lookups.RATINGS]) | checked),
        ("social", social_of(on("social"), publisher)),
        ("gov", (some & (h.endswith(".gov") | h.endswith(".gov.br"))) | has(pub, "minist", "prefeitura", "governo") | (pub == "gov")),
        ("academic", (some & (h.endswith(".edu") | h.endswith(".edu.br") | h.contains(".ac."))) | has(pub, "universidade", "universidad", "university")),
        ("wiki", below("wiki")),
        ("video", below("video")),
        ("forum", below("forum")),
        ("blog", some & (on("blog") | text.has_blog_path(url) | pub.contains("blog"))),
        ("news", (some & (on("news") | has(h, "noticias", "news", "globo.com"))) | has(pub, "noticias", "news", "jornal")),
        ("press-release", below("press")),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in rules])))


def checker_name(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(*[F.when(low.contains(d), F.lit(n)) for d, n in lookups.FACT_CHECK_DOMAINS.items()])


def round_even(c: Column, digits: int) -> Column:
    """A double with so many digits, halves to even: scaled, rounded and scaled back as doubles, not as the decimals they are shown as."""
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def overlap_bucket(ov: Column) -> Column:
    return F.when(ov >= 0.5, ">=50%").when(ov >= 0.4, "40-49%").otherwise("<40%")


def overlap_factor(ov: Column, trust: Column) -> Column:
    return F.when(ov >= 0.5, F.lit(1.0)).when(ov >= 0.4, F.lit(0.95)).when(trust >= 0.85, F.lit(0.9)).otherwise(F.lit(0.85))


def combined_score(rating: Column, sim: Column, trust: Column, ov: Column, rated_as: Column | None = None) -> Column:
    """Score of one piece of evidence, unrounded; rated_as: the rating's score, if it is made already."""
    s = F.greatest(sim, F.lit(0.0))
    rated = F.lit(0.6) * (rating_score(rating) if rated_as is None else rated_as) + F.lit(0.25) * s + F.lit(0.15) * trust
    plain = F.lit(0.45) * s + F.lit(0.40) * trust + F.lit(0.05) * ov
    return F.when(F.coalesce(rating, F.lit("")) != "", rated).otherwise(plain) * overlap_factor(ov, trust)


def _number(w) -> Column:
    return w if isinstance(w, Column) else F.lit(float(w))


def fuse(hist: Column, model: Column, sources: Column, w_hist, w_model, w_sources) -> Column:
    """Weighted mean; a missing score counts as 0 and keeps its weight; 0 weights in all give the plain sum."""
    zero = F.lit(0.0)
    wh, wm, ws = map(_number, (w_hist, w_model, w_sources))
    total = wh + wm + ws
    dotted = wh * F.coalesce(hist, zero) + wm * F.coalesce(model, zero) + ws * F.coalesce(sources, zero)
    return F.when(total > 0, dotted / F.when(total > 0, total)).otherwise(dotted)


def alpha(updates: Column) -> Column:
    """Weight of the incremental model after so many updates."""
    return F.least(F.lit(0.8), F.greatest(F.lit(0.0), 1 - F.exp(-updates / F.lit(25.0))))


def final_score(hist: Column, model: Column, sources: Column, online: Column, updates: Column, w_hist=0.5, w_model=0.35, w_sources=0.33) -> Column:
    """Base fusion, then the incremental model by alpha; no incremental score leaves the base."""
    a = F.when(online.isNull(), F.lit(0.0)).otherwise(alpha(updates))
    base = fuse(hist, model, sources, w_hist, _number(w_model) * (1 - a), w_sources)
    return fuse(base, online, F.lit(0.0), 1 - a, a, 0.0)


def verdict(score: Column) -> Column:
    return F.when(score >= 50, "VERDADEIRO").otherwise("FALSO")


def confidence(score: Column) -> Column:
    return F.when(score >= 50, score).otherwise(100.0 - score)


def model_label(score: Column) -> Column:
    return F.when(score >= 50, "provavelmente verdadeiro").otherwise("provavelmente falso")


def wiki_shares(w_faiss=0.5, w_wiki=0.5) -> tuple[Column, Column]:
    """The two weights over their sum; they may be columns."""
    a, b = _number(w_faiss), _number(w_wiki)
    total = F.greatest(F.lit(1e-6), a + b)
    return a / total, b / total


def with_wiki(faiss: Column, wiki: Column, w_faiss=0.5, w_wiki=0.5) -> Column:
    a, b = wiki_shares(w_faiss, w_wiki)
    return F.when(wiki <= 0, faiss).when(faiss <= 0, wiki).otherwise(faiss * a + wiki * b)


def wiki_weights(faiss: Column, wiki: Column, w_faiss=0.5, w_wiki=0.5) -> tuple[Column, Column]:
    a, b = wiki_shares(w_faiss, w_wiki)
    pick = lambda x, y, z: F.when(wiki <= 0, F.lit(x)).when(faiss <= 0, F.lit(y)).otherwise(z)
    return pick(1.0, 0.0, a), pick(0.0, 1.0, b)


def display_level(v: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v), "").when(v >= 66, "alto").when(v >= 40, "moderado").otherwise("baixo")


def display_number(v: Column) -> Column:
    """One decimal, halves up; -- for null and NaN."""
    return F.when(v.isNull() | F.isnan(v), "--").otherwise((F.floor(v * 10 + 0.5) / 10).cast("string"))


def pie_share(v: Column) -> Column:
    """What a chart shows: 0 for anything that is no finite number."""
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def threshold(raw: Column) -> Column:
    """A confidence threshold from text: per cent above 1, clipped to 0.5..0.99, 0.7 if unreadable."""
    t = F.coalesce(raw.try_cast("double"), F.lit(0.7))
    t = F.when(F.isnan(t), F.lit(0.7)).otherwise(t)
    t = F.when(t > 1, t / 100).otherwise(t)
    return F.greatest(F.lit(0.5), F.least(F.lit(0.99), t))


def margin(w: Column, b: Column, x: Column) -> Column:
    return text.dot(w, x) + b


def sigmoid(m: Column) -> Column:
    return 1 / (1 + F.exp(-m))


def curve(m: Column, bounds: list[float], values: list[float]) -> Column:
    """A curve through the points (bounds, values), straight between them and level outside."""
    x, y = (F.array(*[F.lit(float(v)) for v in c]) for c in (bounds, values))
    i = F.size(F.filter(x, lambda v: v <= m))
    at = lambda c, k: F.element_at(c, k)
    low, high = F.greatest(i, F.lit(1)), F.least(i + 1, F.lit(len(bounds)))
    width = at(x, high) - at(x, low)
    return F.when(width > 0, at(y, low) + (at(y, high) - at(y, low)) * (F.greatest(m, at(x, low)) - at(x, low)) / F.when(width > 0, width)).otherwise(at(y, low))


def probability(w: Column, b: Column, x: Column) -> Column:
    """Logistic P(true) in per cent."""
    return 100.0 * sigmoid(margin(w, b, x))


def auto_label(p: Column, limit: Column, negative: str) -> Column:
    return F.when(p >= limit * 100, "true").otherwise(negative)
