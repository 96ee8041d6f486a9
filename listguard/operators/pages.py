"""Product fields and listing cards from captured pages.

One Arrow step turns HTML into an array of nodes per page; every extractor after it is a
projection over that array, so a page never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listguard.functions import text as tx
from listguard.functions.text import let
from listguard.market import DEFAULT_MARKET, Market

NODES = ("array<struct<ord:int,last:int,parent:int,depth:int,up:bigint,tag:string,classes:array<string>,"
         "attrs:map<string,string>,text:string>>")
_NODE = pa.struct([("ord", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
                   ("up", pa.int64()), ("tag", pa.string()), ("classes", pa.list_(pa.string())),
                   ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

# Labels of specification rows.
SPEC_LABEL = (
    r"(?iU)^(colour|color|size|material|main\s+material|weight|model|gtin|sku|barcode|dimension|brand|style|gender"
    r"|age\s+group|compatible\s+with|connectivity|power\s+source|voltage|wattage|capacity|storage|memory|screen"
    r"|resolution|battery|warranty|type|quantity|number\s+of|set\s+includes|net\s+weight|unit\s+count|flavor|scent"
    r"|finish|texture|pattern|fit\s+type|closure\s+type|sleeve\s+length|collar\s+type|outer\s+material"
    r"|sole\s+material|upper\s+material|heel\s+type|toe\s+style|production|country|manufacturer|origin|made\s+in"
    r"|from\s+the|item\s+weight|package|box\s+contents|box\s+content|included|features?|specification|certified"
    r"|certification|standard)")
# Words of page furniture that are no variants.
FURNITURE = [
    "share", "this", "product", "add", "cart", "wishlist", "compare", "buy", "now", "view", "more", "details",
    "description", "reviews", "rating", "sold", "by", "seller", "store", "official", "report", "incorrect",
    "information", "see", "all", "promotions", "delivery", "returns", "policy", "similar", "products", "from",
    "brand", "print", "email", "copy", "link", "tweet", "pin", "like", "follow", "followers", "score", "shipping",
    "express", "fulfilled", "verified", "in", "on", "at", "and", "or", "the", "a", "an", "with", "for", "of", "to",
    "is", "are", "get", "set", "go", "new", "top", "hot", "sale", "free",
]
# Colours looked for in titles, compound ones first.
TITLE_COLORS = [
    "titanium silver", "titanium gold", "midnight black", "midnight blue", "space gray", "space grey", "rose gold",
    "sky blue", "navy blue", "forest green", "hot pink", "light blue", "dark blue", "dark green", "light green",
    "deep purple", "bright red", "pearl white", "starlight white", "starlight silver", "black", "white", "silver",
    "gold", "blue", "red", "green", "purple", "pink", "grey", "gray", "titanium", "midnight", "starlight", "ivory",
    "champagne", "rose", "copper", "yellow", "orange", "violet", "navy", "cream", "brown", "coral", "aqua", "cyan",
    "teal", "lilac", "maroon", "beige", "olive", "turquoise",
]
# Words that no seller name holds.
SELLER_DENY = ["seller", "store", "view", "follow", "score", "performance", "information", "rating"]
# The like below a seller heading.
SELLER_DENY_BELOW = ["follow", "score", "performance", "rating", "sell on", "contact"]
# The like in texts of shop links.
SELLER_TEXT_DENY = ["terms", "conditions", "credit", "policy", "warranty", "help", "support", "service", "sell on",
                    "official store", "fulfilled", "promotions", "delivery", "returns", "similar", "from", "brand",
                    "follow"]
# Words of navigation addresses.
NAV_WORDS = [
    "home", "phone", "phones", "tablet", "tablets", "fashion", "compute", "computing", "gaming", "games",
    "supermarket", "groceries", "grocery", "health", "beauty", "appliance", "appliances", "office", "baby", "sell",
    "selling", "help", "warranty", "warranties", "privacy", "terms", "conditions", "credit", "store", "official",
    "catalog", "cart", "wishlist", "account", "orders", "order", "return", "returns", "refund", "refunds", "delivery",
    "payment", "payments", "sp", "mlp", "category", "categories", "electronics", "electronic", "television",
    "televisions", "video", "audio", "refrigerator", "refrigerators", "washing", "smartphone", "smartphones",
    "laptop", "laptops", "accessories", "accessory", "clothing", "shoes", "sports", "sport", "outdoor", "garden",
    "toys", "books", "music", "movies", "automotive", "tools", "industrial", "furniture", "kitchen", "dining",
    "bedroom", "bathroom", "lighting", "security", "networking", "software", "printers", "cameras", "smart",
    "wearables", "wearable", "watches",
]
# Headings that end the description.
STOP_HEADS = (r"(?iU)^(specifications?|customer\s+feedback|related\s+results|seller\s+info|promotions?|delivery"
              r"|return\s+policy|seller\s+information)")


# The ancestors that selectors ask for. Each is one of several (tags, attribute, how, value), where a
# missing tag or attribute asks for nothing; ``word`` is one of the attribute's words, ``part`` any part of it.
ANCESTORS = {
    "crumb bar": [(("nav",), "class", "word", "breadcrumb"), ((), "class", "word", "-fdr")],
    "crumb list": [(("ol",), "class", "word", "breadcrumb")],
    "crumb label": [(("nav",), "aria-label", "part", "breadcrumb")],
    "crumb box": [(("div",), "class", "word", "-bre")],
    "crumb class": [(("div",), "class", "part", "breadcrumb")],
    "price box": [(("div",), "class", "word", "-prc-w")],
    "stars": [((), "class", "part", "stars")],
    "review": [((), "class", "part", "review")],
    "variant list": [(("ul",), "class", "word", "-pvs"), (("ul",), "class", "part", "var")],
    "swatch": [((), "data-type", "is", "color"), ((), "data-type", "is", "size"),
               (("li",), "class", "part", "color"), (("li",), "class", "part", "size")],
    "variant box": [(("div",), "class", "part", "var"), (("div",), "class", "part", "size"), (("div",), "class", "part", "color")],
    "order form": [(("form",), "id", "is", "product_addtocart_form"), (("form",), "action", "part", "checkout"),
                   (("section",), "class", "word", "-pvs")],
    "body": [(("body",), None, None, None)],
    "page head": [(("header", "nav"), None, None, None)],
    "seller box": [(("div",), "class", "part", "seller-info")],
    "seller section": [(("section",), "class", "part", "seller")],
    "seller detail": [(("div",), "class", "part", "seller-detail")],
    "list": [(("ul",), None, None, None)],
    "table": [(("table",), None, None, None)],
}
_BIT = {name: 1 << i for i, name in enumerate(ANCESTORS)}


def _selected(tag: str, attrs: dict) -> int:
    """The bits of the ANCESTORS that an element is."""
    bits = 0
    for name, tests in ANCESTORS.items():
        for tags, key, how, value in tests:
            if tags and tag not in tags:
                continue
            held = attrs.get(key)
            if key is None or held is not None and (
                    value in held.split() if how == "word" else value in held if how == "part" else value == held):
                bits |= _BIT[name]
                break
    return bits


class _Nodes(HTMLParser):
    """Flat list of elements and texts in document order, read in one pass over the tags.

    The stack holds the open elements and, with each, the bits of all ANCESTORS open down to it; a node takes the bits above it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.bits, self.tags = [], [], [0], Counter()

    def _add(self, tag, attrs=(), text=None):
        found = {k: v or "" for k, v in reversed(attrs)}
        at = len(self.rows)
        row = {"ord": at, "last": at, "parent": self.open[-1]["ord"] if self.open else -1, "depth": len(self.open),
               "up": self.bits[-1], "tag": tag, "text": text, "attrs": list(found.items()), "classes": found.get("class", "").split()}
        self.rows.append(row)
        return row, found

    def handle_starttag(self, tag, attrs):
        row, found = self._add(tag, attrs)
        if tag not in VOID:
            self.open.append(row)
            self.bits.append(self.bits[-1] | _selected(tag, found))
            self.tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        while self.tags[tag]:
            row = self.open.pop()
            self.bits.pop()
            self.tags[row["tag"]] -= 1
            row["last"] = len(self.rows) - 1
            if row["tag"] == tag:
                return

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] in ("script", "style"):
            self.open[-1]["text"] = (self.open[-1]["text"] or "") + data
        elif data.strip():
            self._add("#text", text=data)

    def done(self):
        for row in self.open:
            row["last"] = len(self.rows) - 1
        return self.rows


def _nodes_of(html: str | None) -> list:
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    return parser.done()


def page_nodes(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``nodes`` of every page."""
    source = pages.select(*keep, "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def parse(batches):
        for batch in batches:
            # One page at a time: node lists of a whole batch would be many times its size.
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                nodes = pa.array([_nodes_of(row.column(len(keep))[0].as_py())], pa.list_(_NODE))
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], nodes], [*keep, "nodes"])
    return source.mapInArrow(parse, f"{schema}, nodes {NODES}")


# ---- selecting nodes -----------------------------------------------------------------------

def has(n: Column, *classes: str) -> Column:
    cond = F.lit(True)
    for c in classes:
        cond = cond & F.array_contains(n.classes, c)
    return cond


def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n.attrs, F.lit(name))


def class_like(n: Column, part: str) -> Column:
    return F.coalesce(F.contains(attr(n, "class"), F.lit(part)), F.lit(False))


def first(nodes: Column, cond) -> Column:
    return F.get(F.filter(nodes, cond), F.lit(0))


def inside(nodes: Column, n: Column) -> Column:
    """The nodes below ``n``: they follow it in ``nodes``, which may be a whole page or all below some node."""
    before = F.get(nodes, F.lit(0)).getField("ord")
    return F.slice(nodes, n.ord - before + 2, n.last - n.ord)


def under(n: Column, ancestor: str) -> Column:
    """True when an ancestor of ``n`` is one of the ANCESTORS so named."""
    return n.up.bitwiseAND(F.lit(_BIT[ancestor])) != 0


def text_of(nodes: Column, n: Column, sep: str = "") -> Column:
    """Trimmed texts below ``n`` joined by ``sep``; null where there is no node."""
    texts = F.transform(F.filter(inside(nodes, n), lambda m: m.tag == "#text"), lambda m: tx.strip_ws(m.text))
    return F.when(n.isNotNull(), F.array_join(texts, sep))


def first_text(nodes: Column, cond, sep: str = "") -> Column:
    return let(first(nodes, cond), lambda n: text_of(nodes, n, sep))


def first_attr(nodes: Column, cond, name: str) -> Column:
    return let(first(nodes, cond), lambda n: attr(n, name))


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def any_word(c: Column, words) -> Column:
    return F.lower(c).rlike(tx.alternation(list(words)))


def absolute(url: Column, base: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(
        url.startswith("/"), F.concat(base, url)).otherwise(url)


# ---- listing pages -------------------------------------------------------------------------

def listing_cards(pages: DataFrame, base_url: str = "") -> DataFrame:
    """One row per product card of a listing page."""
    cards = page_nodes(pages, ["page_id"]).select(
        "page_id", F.posexplode(F.transform(F.filter("nodes", lambda n: (n.tag == "article") & has(n, "prd")), lambda n: F.struct(
            n.alias("card"), inside(F.col("nodes"), n).alias("cn")))).alias("i", "c"))
    own = cards.select("page_id", "i", "c.card", "c.cn")
    cn, base = F.col("cn"), F.lit(base_url)
    href = F.coalesce(first_attr(cn, lambda n: (n.tag == "a") & has(n, "core"), "href"), F.lit(""))

    def text(cond, sep=""):
        return F.coalesce(first_text(cn, cond, sep), F.lit(""))

    def digits(c):
        return F.regexp_replace(c, r"[^0-9.]", "")

    def flag(cond):
        return F.when(F.exists(cn, cond), F.lit("Yes")).otherwise("No")
    stars = first(cn, lambda n: (has(n, "stars") & has(n, "_s")) | has(n, "-rtg"))
    width = let(stars, lambda n: F.regexp_extract(F.coalesce(attr(n, "style"), F.lit("")), r"width:\s*([\d.]+)%", 1))
    rating = F.when(width != "", F.bround(width.try_cast("double") / 20, 1).cast("string")).otherwise(
        F.coalesce(let(stars, lambda n: text_of(cn, n)), F.lit("")))
    image = let(first(cn, lambda n: n.tag == "img"), lambda n: F.coalesce(
        filled(attr(n, "data-src")), filled(attr(n, "data-original")), attr(n, "src"), F.lit("")))
    url = F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)
    stepped = own.select("page_id", "i", "card", "cn", url.alias("url"), image.alias("image"))
    sku = F.coalesce(filled(attr(F.col("card"), "data-id")), filled(attr(F.col("card"), "data-sku")),
                     filled(F.regexp_extract("url", r"-(\d{6,12})\.html", 1)),
                     F.concat(F.lit("UNK-"), F.col("i").cast("string")))
    return stepped.select(
        "page_id", sku.alias("SKU"), text(lambda n: has(n, "name")).alias("Name"),
        text(lambda n: has(n, "brand")).alias("Brand"), F.lit("").alias("Category"),
        digits(text(lambda n: has(n, "prc"))).alias("Price"), digits(text(lambda n: has(n, "old"))).alias("Old Price"),
        text(lambda n: has(n, "-dsc") | has(n, "bdg", "_dsct")).alias("Discount"), rating.alias("Rating"),
        F.regexp_replace(text(lambda n: has(n, "rev")), r"\D", "").alias("Total Ratings"),
        F.coalesce(attr(F.col("card"), "data-seller"), F.lit("")).alias("Seller"),
        flag(lambda n: has(n, "-jump") | has(n, "xpr") | class_like(n, "express")).alias("Express"),
        flag(lambda n: has(n, "-glb") | class_like(n, "global")).alias("Shop Global"),
        absolute(F.col("image"), base).alias("Image URL"), F.col("url").alias("Product URL"),
        F.coalesce(first_text(cn, lambda n: has(n, "-avl") | class_like(n, "stock")), F.lit("In Stock")).alias("Stock"),
        text(lambda n: has(n, "tags") | class_like(n, "tag"), " ").alias("Tags"))


def page_count(nodes: Column) -> Column:
    """Highest page number named by a marker or a link, at least what the page itself is: 1."""
    marked = F.transform(F.filter(nodes, lambda n: attr(n, "data-page").isNotNull()),
                         lambda n: attr(n, "data-page").try_cast("int"))
    linked = F.transform(F.filter(nodes, lambda n: (n.tag == "a") & F.contains(attr(n, "href"), F.lit("page="))),
                         lambda n: F.regexp_extract(attr(n, "href"), r"page=(\d+)", 1).try_cast("int"))
    return F.coalesce(F.array_max(F.concat(marked, linked)), F.lit(1))


def breadcrumb(nodes: Column) -> Column:
    """Last breadcrumb that is not the home page."""
    crumbs = F.filter(nodes, lambda n: ((n.tag == "span") & under(n, "crumb bar"))
                      | ((n.tag == "li") & under(n, "crumb list")))
    texts = F.filter(F.transform(crumbs, lambda n: text_of(nodes, n)),
                     lambda t: ~F.lower(t).isin("home", "accueil", ""))
    return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))


# ---- product pages -------------------------------------------------------------------------

def product_json(nodes: Column) -> Column:
    """The page's linked-data record of type Product, as JSON text."""
    blobs = F.transform(F.filter(nodes, lambda n: (n.tag == "script") & (attr(n, "type") == "application/ld+json")),
                        lambda n: tx.strip_ws(F.coalesce(n.text, F.lit(""))))
    records = F.flatten(F.transform(blobs, lambda b: F.when(
        b.startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b))))
    return F.get(F.filter(records, lambda r: F.get_json_object(r, "$.@type") == "Product"), F.lit(0))


def _scripts(nodes: Column, word: str, pattern: str) -> Column:
    texts = F.transform(F.filter(nodes, lambda n: (n.tag == "script") & F.contains(F.coalesce(n.text, F.lit("")), F.lit(word))),
                        lambda n: F.regexp_extract(n.text, pattern, 1))
    return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))


def embedded_fields(nodes: Column) -> dict[str, Column]:
    """Price, brand, category and image from the page's script data."""
    layer = F.coalesce(_scripts(nodes, "dataLayer", r"(?s)dataLayer\s*=\s*(\[.*?\])\s*;"),
                       _scripts(nodes, "dataLayer", r"(?s)dataLayer\.push\s*\((\{.*?\})\s*\)"))
    store = _scripts(nodes, "__STORES__", r"(?s)__STORES__\s*=\s*(\{.+?\})\s*;")

    def from_layer(key):
        roots = [r + s for r in ("$[0]", "$") for s in (".ecommerce.detail.products[0].", ".ecommerce.products[0].",
                                                        ".detail.products[0].", ".products[0].", ".ecommerce.detail.",
                                                        ".ecommerce.", ".detail.", ".")]
        return F.coalesce(*[filled(F.get_json_object(layer, r + key)) for r in roots])

    def from_store(key):
        return F.coalesce(*[filled(F.get_json_object(store, f"$.{r}{key}")) for r in ("pdp.product.", "pdp.", "product.", "")])
    return {"PRICE": F.regexp_replace(F.coalesce(from_layer("price"), from_store("price")), ",", ""),
            "BRAND": from_layer("brand"), "CATEGORY_PATH": from_layer("category"), "MAIN_IMAGE": from_store("image")}


def json_fields(ld: Column) -> dict[str, Column]:
    def at(path):
        return filled(F.get_json_object(ld, path))
    image, brand = at("$.image"), at("$.brand")
    stock = F.coalesce(at("$.offers.availability"), at("$.offers[0].availability"))
    description = tx.strip_ws(at("$.description"))
    return {
        "MAIN_IMAGE": F.when(image.startswith("["), F.get_json_object(ld, "$.image[0]")).otherwise(image),
        "DESCRIPTION": F.when(F.length(at("$.description")) > 20, description),
        "BRAND": tx.strip_ws(F.when(brand.startswith("{"), at("$.brand.name")).otherwise(brand)),
        "PRICE": F.regexp_replace(F.coalesce(*[at(p) for p in ("$.offers.price", "$.offers[0].price", "$.offers.lowPrice",
                                                               "$.offers[0].lowPrice")]), ",", ""),
        "STOCK": F.when(F.contains(stock, F.lit("InStock")), "In Stock").when(F.contains(stock, F.lit("OutOfStock")), "Out of Stock"),
        "RATING": at("$.aggregateRating.ratingValue"),
        "REVIEW_COUNT": F.coalesce(at("$.aggregateRating.reviewCount"), at("$.aggregateRating.ratingCount")),
        "MODEL": tx.strip_ws(at("$.model")),
        "GTIN": tx.strip_ws(F.coalesce(*[at(f"$.{k}") for k in ("gtin13", "gtin12", "gtin8", "gtin", "barcode")])),
        "WEIGHT": F.coalesce(F.concat(at("$.weight.value"), F.lit(" "), F.coalesce(at("$.weight.unitCode"), F.lit("kg"))),
                             F.when(~at("$.weight").startswith("{"), at("$.weight"))),
        "SELLER": F.when(F.length(F.coalesce(at("$.seller.name"), at("$.seller"))) <= 60, tx.strip_ws(F.coalesce(
            at("$.seller.name"), F.when(~at("$.seller").startswith("{"), at("$.seller"))))),
    }


def _number(text: Column) -> Column:
    """A price of 100 or more as plain number text."""
    value = F.regexp_replace(F.regexp_replace(text, r"[^0-9,.]", ""), ",", "").try_cast("double")
    shown = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(
        F.regexp_replace(F.format_number(value, 2), ",", ""))
    return F.when(value >= 100, shown)


def html_fields(nodes: Column, full: Column, market: Market) -> dict[str, Column]:
    """Image, price, discount, rating, reviews and stock by order of selectors."""
    def text(cond):
        return first_text(nodes, cond)

    def image_ok(src):
        ok = F.contains(src, F.lit("product")) | F.contains(src, F.lit("unsafe"))
        for h in market.image_hosts:
            ok = ok | F.contains(src, F.lit(h))
        return ok
    sources = F.transform(F.filter(nodes, lambda n: (n.tag == "img") & has(n, "-fw", "-fh")),
                          lambda n: F.coalesce(filled(attr(n, "data-src")), attr(n, "src"), F.lit("")))
    prices = [lambda n: (n.tag == "span") & has(n, "-b", "-ltr", "-tal", "-fs24"), lambda n: (n.tag == "span") & has(n, "prc"),
              lambda n: (n.tag == "span") & attr(n, "data-price").isNotNull(), lambda n: (n.tag == "span") & has(n, "-b", "-ltr", "-tal"),
              lambda n: (n.tag == "span") & under(n, "price box")]
    discounts = [lambda n: (n.tag == "span") & has(n, "bdg", "_dsct", "_sm"), lambda n: (n.tag == "span") & has(n, "_dsct"),
                 lambda n: class_like(n, "discount")]
    ratings = [lambda n: (n.tag == "div") & has(n, "stars", "_s"),
               lambda n: (n.tag == "span") & under(n, "stars"),
               lambda n: (n.tag == "div") & attr(n, "data-rating").isNotNull()]
    reviews = [lambda n: (n.tag == "a") & F.contains(attr(n, "href"), F.lit("#reviews")), lambda n: (n.tag == "span") & class_like(n, "revw"),
               lambda n: (n.tag == "span") & under(n, "review")]
    unrated = F.when(full.rlike(r"(?iU)no\s+ratings?\s+(?:yet|available)"), F.lit("0"))
    stock = F.coalesce(*[F.when(F.length(text(c)) < 80, filled(text(c))) for c in (
        lambda n: (n.tag == "span") & class_like(n, "stock"), lambda n: (n.tag == "div") & class_like(n, "stock"),
        lambda n: (n.tag == "span") & class_like(n, "avail"), lambda n: (n.tag == "div") & class_like(n, "avail"),
        lambda n: (n.tag == "p") & class_like(n, "stock"))],
        filled(F.regexp_extract(full, r"(?iU)((?:some\s+)?variations?\s+with\s+low\s+stock|low\s+stock|only\s+\d+\s+left"
                                r"|hurry[,!]?\s+(?:only\s+)?\d+|in\s+stock|out\s+of\s+stock|sold\s+out)", 1)))
    gone = F.exists(nodes, lambda n: ((n.tag == "div") & has(n, "out-of-stock")) | class_like(n, "sold-out")
                    | class_like(n, "out-of-stock") | ((n.tag == "button") & attr(n, "disabled").isNotNull()))
    return {
        "MAIN_IMAGE": F.coalesce(filled(first_attr(nodes, lambda n: (n.tag == "meta") & (attr(n, "property") == "og:image"), "content")),
                                 F.get(F.filter(sources, lambda s: (s != "") & image_ok(s)), F.lit(0))),
        "PRICE": F.coalesce(*[_number(text(c)) for c in prices]),
        "DISCOUNT": F.coalesce(*[F.when(F.contains(text(c), F.lit("%")), text(c)) for c in discounts]),
        "RATING": F.coalesce(*[filled(F.regexp_extract(F.coalesce(filled(first_attr(nodes, c, "data-rating")), text(c)), r"(\d+\.?\d*)", 1))
                               for c in ratings], unrated),
        "REVIEW_COUNT": F.coalesce(*[filled(F.regexp_extract(text(c), r"(\d+)", 1)) for c in reviews],
                                   filled(F.regexp_extract(full, r"(?iU)(\d+)\s+verified\s+ratings?", 1)), unrated),
        "STOCK": stock, "GONE": gone,
    }


def _pills(nodes: Column, cond, market: Market) -> Column:
    """Values of the variant elements meeting ``cond`` that are no labels or furniture."""
    def value(n):
        own = inside(nodes, n)
        field = first(own, lambda m: m.tag == "input")
        span = first(own, lambda m: (m.tag == "span") & (m.parent == n.ord))
        return tx.strip_ws(F.when(field.isNotNull(), F.coalesce(filled(attr(field, "value")), attr(field, "data-value"), F.lit("")))
                           .when(span.isNotNull(), let(span, lambda s: text_of(nodes, s))).otherwise(text_of(nodes, n)))
    words = F.array(*[F.lit(w) for w in [*FURNITURE, market.name.lower()]])
    values = F.transform(F.filter(nodes, cond), value)
    return F.filter(values, lambda v: (v != "") & ~F.contains(v, F.lit(": ")) & ~F.contains(v, F.lit(","))
                    & ~v.rlike(SPEC_LABEL) & ~F.array_contains(words, F.lower(v)))


def variant_values(nodes: Column, full: Column, market: Market = DEFAULT_MARKET) -> Column:
    """Distinct variant values by the first strategy that yields any."""
    def a(n):
        return (n.tag == "li") & under(n, "variant list")

    def b(n):
        return ((n.tag == "span") & (has(n, "color-selector") | under(n, "swatch"))) | ((n.tag == "label") & class_like(n, "color"))

    def d(n):
        return (n.tag == "button") & under(n, "variant box")
    options = F.filter(F.transform(F.filter(nodes, lambda n: (n.tag == "option") & (F.coalesce(attr(n, "value"), F.lit("x")) != "")
                                            & attr(n, "disabled").isNull() & under(n, "order form")), lambda n: text_of(nodes, n)),
                       lambda t: t != "")
    tried = F.array(_pills(nodes, a, market), _pills(nodes, b, market), options, _pills(nodes, d, market))
    found = F.array_distinct(F.coalesce(F.get(F.filter(tried, lambda v: F.size(v) > 0), F.lit(0)), F.array().cast("array<string>")))

    def split_single(v):
        tokens = tx.variant_tokens(F.get(v, F.lit(0)))
        return F.when((F.size(v) == 1) & ~tx.is_size(F.get(v, F.lit(0))) & (F.size(tokens) >= 2), tokens).otherwise(v)
    said = tx.variant_tokens(filled(tx.strip_ws(F.regexp_extract(full, r"(?i)Variation\s+available\s*\n([^\n]{2,80})", 1))))
    block = let(first(nodes, lambda n: n.tag.isin("section", "div", "ul") & has(n, "-pvs")), lambda n: text_of(nodes, n, " "))
    block = tx.strip_ws(F.regexp_replace(block, r"(?i)(Variation\s+available|Add\s+to\s+cart|Some\s+variations|low\s+stock)", ""))
    shown = tx.variant_tokens(F.when(block != "", block))
    shown = F.when(~F.exists(shown, lambda t: t.rlike(SPEC_LABEL)), shown)
    title = first_text(nodes, lambda n: n.tag.isin("h1", "title"))
    named = F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(_single_colors()), F.lit(0)), tx.title_case))
    empty = F.array().cast("array<string>")
    return let(found, lambda v: F.coalesce(*[F.when(F.size(x) > 0, x) for x in (split_single(v), said, shown, named)], empty))


def _single_colors() -> str:
    return r"(?iU)\b(" + "|".join(c for c in TITLE_COLORS if " " not in c) + r")\b"


def variant_fields(values: Column) -> dict[str, Column]:
    sizes, colors = F.filter(values, tx.is_size), F.filter(values, lambda v: ~tx.is_size(v))
    ns, nc = F.size(sizes), F.size(colors)
    return {"SIZES_AVAILABLE": filled(F.array_join(sizes, ", ")), "COLOR": filled(F.array_join(colors, ", ")),
            "COUNT_VARIATIONS": F.when((ns > 0) & (nc > 0), ns * nc).when(ns > 0, ns).when(nc > 0, nc).cast("string")}


def title_color(nodes: Column) -> Column:
    """Colours named in the heading, else in the title; compound colours first."""
    title = F.coalesce(filled(first_text(nodes, lambda n: n.tag == "h1", " ")), first_text(nodes, lambda n: n.tag == "title", " "))
    pattern = r"(?iU)\b(" + "|".join(TITLE_COLORS).replace(" ", r"\s+") + r")\b"
    found = F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(pattern), F.lit(0)), tx.title_case))
    return F.coalesce(filled(F.array_join(found, ", ")), F.lit("None"))


def _spec_items(nodes: Column, wide: bool) -> Column:
    """Texts of the items of the specification sections, in page order."""
    def section(n):
        base = n.tag.isin("div", "section", "ul") & class_like(n, "spec")
        return base | (n.tag.isin("div", "section") & has(n, "-atr")) if wide else base

    def items(s):
        lis = F.filter(inside(nodes, s), lambda m: m.tag == "li")
        divs = F.filter(inside(nodes, s), lambda m: (m.tag == "div") & (m.parent == s.ord))
        return F.transform(F.when(F.size(lis) > 0, lis).otherwise(divs), lambda m: text_of(nodes, m, " "))
    return F.flatten(F.transform(F.filter(nodes, section), items))


def spec_map(nodes: Column) -> Column:
    """Specification keys and values; a later value of a key wins."""
    def entry(t):
        colon = F.contains(t, F.lit(":"))
        k = F.when(colon, F.split_part(t, F.lit(":"), F.lit(1))).otherwise(F.get(F.split(t, r"\s{2,}", 2), F.lit(0)))
        v = F.when(colon, F.regexp_replace(t, r"(?s)^[^:]*:", "")).otherwise(F.get(F.split(t, r"\s{2,}", 2), F.lit(1)))
        return F.struct(F.replace(F.lower(tx.strip_ws(k)), F.lit(" "), F.lit("_")).alias("k"), tx.strip_ws(v).alias("v"))
    entries = F.filter(F.transform(_spec_items(nodes, False), entry), lambda e: (e.k != "") & (e.v != ""))
    keys = F.array_distinct(F.transform(entries, lambda e: e.k))
    return let(entries, lambda es: F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.element_at(F.filter(es, lambda e: e.k == k), -1).v)))


def spec_value(spec: Column, *names: str) -> Column:
    return F.coalesce(*[filled(F.try_element_at(spec, F.lit(n))) for n in names])


def category_path(nodes: Column) -> Column:
    """Breadcrumb links joined by `` > ``, without the home link and an over-long last one."""
    spots = ["crumb list", "crumb label", "crumb box", None, "crumb class"]

    def links(spot):
        if spot is None:
            return F.filter(nodes, lambda n: (n.tag == "a") & class_like(n, "crumb"))
        return F.filter(nodes, lambda n: (n.tag == "a") & under(n, spot))

    def texts(found):
        return F.filter(F.transform(found, lambda n: text_of(nodes, n)), lambda t: t != "")
    by_selector = F.array(*[texts(links(s)) for s in spots])
    lists = F.transform(F.filter(nodes, lambda n: n.tag.isin("nav", "ol", "ul")), lambda s: texts(
        F.filter(inside(nodes, s), lambda m: m.tag == "a")))
    plausible = F.filter(lists, lambda t: F.size(t).between(3, 7) & (F.size(F.array_distinct(t)) == F.size(t))
                         & F.forall(t, lambda x: F.length(x) < 50))
    crumbs = F.coalesce(F.get(F.filter(by_selector, lambda t: F.size(t) > 0), F.lit(0)), F.get(plausible, F.lit(0)))

    def trimmed(c):
        head = F.when(F.lower(F.get(c, F.lit(0))).isin("home"), F.slice(c, F.lit(2), F.size(c))).otherwise(c)
        return let(head, lambda h: F.when(F.length(F.try_element_at(h, F.lit(-1))) > 60, F.slice(h, F.lit(1), F.size(h) - 1)).otherwise(h))
    return filled(F.array_join(let(crumbs, trimmed), " > "))


def official_store(nodes: Column, market: Market) -> Column:
    """Yes when a badge, a text outside header and navigation, or an image names an official store."""
    words = r"(?iU)\bofficial\s+store\b"
    badge = F.exists(nodes, lambda n: (n.tag == "a") & (F.contains(attr(n, "href"), F.lit(market.official_tag))
                                                       | F.contains(attr(n, "tag"), F.lit(market.official_tag))))
    said = F.exists(nodes, lambda n: (n.tag == "#text") & n.text.rlike(words) & under(n, "body")
                    & ~under(n, "page head"))
    shown = F.exists(nodes, lambda n: (n.tag == "img") & attr(n, "alt").rlike(words))
    yes = F.coalesce(badge, F.lit(False)) | F.coalesce(said, F.lit(False)) | F.coalesce(shown, F.lit(False))
    return F.when(yes, F.lit("Yes")).otherwise("No")


def seller_name(nodes: Column, ld_seller: Column, market: Market) -> Column:
    """Seller by four scoped strategies."""
    name = market.name.lower()
    scoped = [lambda n: (n.tag == "a") & attr(n, "href").isNotNull() & under(n, "seller box"),
              lambda n: (n.tag == "a") & attr(n, "href").isNotNull() & under(n, "seller section"),
              lambda n: (n.tag == "a") & attr(n, "href").isNotNull() & under(n, "seller detail"),
              lambda n: (n.tag == "a") & class_like(n, "seller-name"), lambda n: (n.tag == "a") & class_like(n, "store-name")]

    def fit(t, deny):
        return F.when(F.length(t).between(2, 60) & ~any_word(t, deny), t)
    by_class = [fit(first_text(nodes, c), [*SELLER_DENY, name]) for c in scoped]
    head = first(nodes, lambda n: n.tag.isin("h2", "h3", "h4", "b", "strong", "div", "section")
                 & text_of(nodes, n).rlike(r"(?iU)seller\s+information"))
    # Links after a later heading also follow the first one, which decides therefore.
    below = let(head, lambda h: F.get(F.filter(F.transform(F.filter(
        nodes, lambda n: (n.tag == "a") & attr(n, "href").isNotNull() & (n.ord > h.ord)),
        lambda n: fit(text_of(nodes, n), [*SELLER_DENY_BELOW, name])), lambda t: t.isNotNull()), F.lit(0)))
    after_price = F.coalesce(*[first(nodes, c) for c in (
        lambda n: (n.tag == "span") & has(n, "-b", "-ltr", "-tal", "-fs24"), lambda n: (n.tag == "span") & has(n, "prc"),
        lambda n: (n.tag == "div") & has(n, "-prc-w"))]).getField("parent")
    nav = F.array(*[F.lit(w) for w in [*NAV_WORDS, name]])
    linked = let(F.coalesce(after_price, F.lit(-1)), lambda p: F.filter(
        nodes, lambda n: (n.tag == "a") & attr(n, "href").isNotNull() & (n.ord > p)))
    slugs = F.filter(linked, lambda n: attr(n, "href").rlike(r"^/[a-z0-9][a-z0-9\-]{3,40}(?:-cod)?/$") & ~F.arrays_overlap(
        F.split(F.regexp_replace(F.regexp_replace(attr(n, "href"), "/", ""), "-cod", ""), "-"), nav))
    by_slug = F.get(F.filter(F.transform(slugs, lambda n: text_of(nodes, n)), lambda t: (t != "") & (F.length(t) <= 60)
                             & ~any_word(t, SELLER_TEXT_DENY)), F.lit(0))
    heading = first(nodes, lambda n: n.tag.isin("h2", "h3", "h4", "b", "strong") & text_of(nodes, n).rlike(r"(?iU)seller\s+information"))
    beside = let(heading, lambda h: F.get(F.filter(F.transform(F.filter(
        nodes, lambda n: (n.parent == h.parent) & (n.ord > h.last) & (n.tag != "#text")), lambda n: text_of(nodes, n)),
        lambda t: F.length(t).between(2, 60)), F.lit(0)))
    return F.coalesce(*by_class, below, by_slug, filled(ld_seller), beside)


def warranty(nodes: Column, full: Column) -> dict[str, Column]:
    stated = filled(tx.strip_ws(F.regexp_extract(full, r"(?iU)(\d+[\s\-]?(?:year|month|yr|mo)[s]?\s+(?:warranty|guarantee))", 1)))
    rows = F.filter(nodes, lambda n: ((n.tag == "li") & under(n, "list"))
                    | ((n.tag == "tr") & under(n, "table")) | ((n.tag == "div") & has(n, "-fs14")))
    texts = F.filter(F.transform(rows, lambda n: text_of(nodes, n, " ")), lambda t: t.rlike("(?i)warranty"))
    cleaned = F.transform(texts, lambda t: tx.strip_ws(F.regexp_replace(t, r"[Ww]arranty\s*[:\-]?\s*", "")))
    row = F.get(F.filter(cleaned, lambda v: (v != "") & (F.length(v) < 80)), F.lit(0))
    address = filled(tx.strip_ws(F.regexp_extract(full, r"(?iU)Warranty\s+Address\s*[:\-]?\s*(.+?)(?:\n|$)", 1)))
    duration = F.coalesce(stated, row, address)
    return {"PRODUCT_WARRANTY": F.when(duration.isNotNull(), F.lit("Yes")), "WARRANTY_DURATION": duration}


def spec_texts(nodes: Column, spec: Column, model: Column, weight: Column) -> dict[str, Column]:
    lines = F.filter(_spec_items(nodes, True), lambda t: F.contains(t, F.lit(":")))
    known = [("SKU", model), ("Weight (kg)", weight), ("Main Material", spec_value(spec, "main_material")),
             ("Size (L x W H)", spec_value(spec, "size_(l_x_w_x_h_cm)"))]

    def with_known(ls):
        extra = [_missing_line(ls, label, value) for label, value in known]
        return F.concat(ls, F.array_compact(F.array(*extra)))
    parts = [F.concat(F.lit(label + ": "), spec_value(spec, key)) for label, key in (
        ("SKU", "sku"), ("Size", "size_(l_x_w_x_h_cm)"), ("Weight", "weight_(kg)"), ("Material", "main_material"), ("GTIN", "gtin_barcode"))]
    sku = F.when(spec_value(spec, "sku").isNull(), F.concat(F.lit("SKU: "), model))
    heavy = F.when(spec_value(spec, "weight_(kg)").isNull(), F.concat(F.lit("Weight: "), weight, F.lit(" kg")))
    return {"SPECIFICATIONS": filled(F.array_join(let(lines, with_known), " | ")),
            "KEY_SPECS": filled(F.concat_ws(" | ", sku, *parts, heavy))}


def _missing_line(lines: Column, label: str, value: Column) -> Column:
    named = F.exists(lines, lambda t: F.contains(F.lower(t), F.lit(label.lower())))
    return F.when(value.isNotNull() & ~named, F.concat(F.lit(label + ": "), value))


def list_after(nodes: Column, pattern: str) -> Column:
    """Items of the first list that follows a heading matching ``pattern``, joined by `` | ``."""
    lists, stops = (F.filter(nodes, lambda n: n.tag == "ul"), F.filter(nodes, lambda n: n.tag.isin("h2", "h3", "h4")))

    def following(h):
        stop = F.coalesce(first(stops, lambda n: n.ord > h.last).getField("ord"), F.lit(2147483647))
        return let(stop, lambda o: F.filter(lists, lambda u: (u.ord > h.last) & (u.ord < o)))
    heads = F.filter(nodes, lambda n: n.tag.isin("h2", "h3", "h4", "b", "strong") & text_of(nodes, n).rlike(pattern))
    found = F.flatten(F.transform(heads, following))
    items = let(F.get(found, F.lit(0)), lambda u: F.filter(F.transform(F.filter(
        inside(nodes, u), lambda n: (n.tag == "li") & (n.parent == u.ord)), lambda n: text_of(nodes, n, " ")), lambda t: t != ""))
    return filled(F.array_join(items, " | "))


def description(nodes: Column, base_url: str) -> Column:
    """Blocks between the details heading and the next section, images by address, repeats dropped."""
    start = F.get(F.filter(nodes, lambda n: n.tag.isin("h2", "h3", "h4") & text_of(nodes, n, " ").rlike(r"(?iU)product\s+details?")), F.lit(0))
    stop = let(start, lambda s: F.coalesce(F.get(F.transform(F.filter(nodes, lambda n: n.tag.isin("h2", "h3", "h4") & (n.ord > s.ord)
                                                                   & text_of(nodes, n, " ").rlike(STOP_HEADS)), lambda n: n.ord), F.lit(0)), F.lit(2147483647)))

    def source(n):
        return absolute(F.coalesce(filled(attr(n, "data-src")), filled(attr(n, "data-original")), filled(attr(n, "data-lazy")),
                                   attr(n, "src"), F.lit("")), F.lit(base_url))
    skip = "nav|bread|cart|seller|rate|review|footer|header|sidebar|related|promo|banner"
    blocks = let(F.struct(start.getField("ord").alias("a"), stop.alias("b")), lambda r: F.filter(nodes, lambda n: (
        n.ord > r["a"]) & (n.ord < r["b"]) & n.tag.isin("p", "ul", "ol", "img", "h2", "h3", "h4", "div")
        & ~((n.tag == "div") & F.coalesce(F.lower(attr(n, "class")), F.lit("")).rlike(skip))))
    images = F.filter(F.transform(F.filter(blocks, lambda n: n.tag == "img"), source), lambda s: (s != "") & ~s.startswith("data:"))
    texts = F.filter(F.transform(F.filter(blocks, lambda n: n.tag.isin("p", "ul", "ol", "h2", "h3", "h4")),
                                 lambda n: text_of(nodes, n, " ")), lambda t: t != "")
    prepared = F.when(F.size(texts) > 0, texts).otherwise(F.array_distinct(images))

    def distinct(parts):
        keys = F.transform(parts, lambda p: tx.squeeze(p))
        return let(keys, lambda ks: F.filter(parts, lambda p, i: F.array_position(ks, F.get(ks, i)) == i + 1))
    fallback = first_text(nodes, lambda n: (n.tag == "div") & (has(n, "-prd-desc") | class_like(n, "description")), " ")
    return F.coalesce(filled(F.array_join(let(prepared, distinct), "\n")), filled(fallback))


def product_fields(pages: DataFrame, keep: list[str], base_url: str = "", market: Market = DEFAULT_MARKET) -> DataFrame:
    """The ``keep`` columns and the 24 page fields of every captured product page."""
    nodes = F.col("nodes")
    parsed = page_nodes(pages, keep)
    texts = F.transform(F.filter(nodes, lambda n: n.tag == "#text"), lambda n: tx.strip_ws(n.text))
    step = parsed.select("*", F.array_join(texts, " ").alias("_full"), product_json(nodes).alias("_ld"),
                         spec_map(nodes).alias("_spec"))
    full, spec = F.col("_full"), F.col("_spec")
    ld, emb, htm = json_fields(F.col("_ld")), embedded_fields(nodes), html_fields(nodes, full, market)
    step = step.select("*", variant_values(nodes, full, market).alias("_variants"),
                       F.coalesce(ld["MODEL"], spec_value(spec, "model", "model_name", "model_number"),
                                  filled(tx.strip_ws(F.regexp_extract(full, r"(?iU)\bModel\s*[:\-]\s*([^\n,]+)", 1)))).alias("MODEL"),
                       F.coalesce(spec_value(spec, "weight_(kg)", "weight_kg", "weight_(g)", "weight"), ld["WEIGHT"],
                                  filled(tx.strip_ws(F.regexp_extract(full, r"(?iU)Weight\s*(?:\(kg\))?\s*[:\-]\s*([\d\.]+\s*(?:kg|g)?)", 1)))).alias("WEIGHT"))
    stock = htm["STOCK"]
    out = {
        "PRICE": F.coalesce(htm["PRICE"], emb["PRICE"], ld["PRICE"]), "DISCOUNT": htm["DISCOUNT"],
        "STOCK_STATUS": F.when(stock.isNotNull(), F.concat(F.upper(F.substring(stock, 1, 1)), F.lower(F.substr(stock, F.lit(2)))))
        .when(htm["GONE"], F.lit("Out of Stock")).otherwise(F.coalesce(ld["STOCK"], F.lit("In Stock"))),
        "MODEL": F.col("MODEL"),
        "GTIN": F.coalesce(ld["GTIN"], spec_value(spec, "gtin_barcode", "gtin", "barcode", "ean", "upc"),
                           filled(F.regexp_extract(full, r"(?i)GTIN\s*(?:Barcode)?\s*[:\-]\s*(\d{8,14})", 1))),
        "BRAND": F.coalesce(ld["BRAND"], emb["BRAND"]),
        "CATEGORY_PATH": F.coalesce(emb["CATEGORY_PATH"], category_path(nodes)),
        "IS_OFFICIAL_STORE": official_store(nodes, market),
        "MAIN_IMAGE": F.coalesce(ld["MAIN_IMAGE"], emb["MAIN_IMAGE"], htm["MAIN_IMAGE"]), "WEIGHT": F.col("WEIGHT"),
        "COLOR_IN_TITLE": title_color(nodes), **variant_fields(F.col("_variants")), **warranty(nodes, full),
        "RATING": F.coalesce(ld["RATING"], htm["RATING"]), "REVIEW_COUNT": F.coalesce(ld["REVIEW_COUNT"], htm["REVIEW_COUNT"]),
        "SELLER_NAME": seller_name(nodes, ld["SELLER"], market),
        "DESCRIPTION": F.coalesce(ld["DESCRIPTION"], description(nodes, base_url)),
        "KEY_FEATURES": list_after(nodes, r"(?iU)key\s+features?"),
        "WHATS_IN_BOX": list_after(nodes, r"(?iU)what.{0,5}s?\s+in\s+the\s+box"),
        **spec_texts(nodes, spec, F.col("MODEL"), F.col("WEIGHT")),
    }
    from listguard.operators.audit import PAGE_FIELDS
    return step.select(*keep, *[out[f].alias(f) for f in PAGE_FIELDS])
