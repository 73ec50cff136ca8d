"""What a page's own style sheets hide.

Rules are data here, other ones on every page, so they aren't compiled but joined: a rule's last compound is looked up by
its id, a class or its tag among the elements' own, verified, and its further compounds are met one by one as parents or
ancestors, each step a join by page and rule. Of the rules for a property the winner is the important one, then the more
specific one, then the later one; an element's own style wins over all that are not important.

An element is hidden by display: none, by visibility: hidden or collapse, and by being clipped to nothing while it is taken
out of the flow. It gets the attribute `hidden`, by which all later steps know it. Read are <style> elements without their
at-rules (media and the like); selectors of tag, *, .class, #id and the combinators descendant and >. Rules with anything
else are passed over, as are linked sheets, which aren't there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.nodes import TEXT, attr
from lectern.plans.storage import stored

#: Properties that can hide.
PROPERTIES = ("display", "visibility", "position", "clip", "clip-path")
_PLAIN = r"^(?:[\w-]+|\*)?(?:[.#][\w-]+)*(?:(?:\s*>\s*|\s+)(?:[\w-]+|\*)?(?:[.#][\w-]+)*)*$"


def declarations(text: Column) -> Column:
    """Array of (property, value, important) of a list of declarations, those that can hide."""
    pairs = F.transform(F.split(F.lower(text), ";"), lambda d: F.split(d, ":", 2))
    rows = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.named_struct(F.lit("property"), F.trim(p[0]), F.lit("value"), F.trim(F.regexp_replace(p[1], r"\s*!\s*important", "")), F.lit("important"), p[1].rlike(r"!\s*important")))
    return F.filter(rows, lambda d: d["property"].isin(*PROPERTIES))


def rules(nodes: DataFrame) -> DataFrame:
    """(page_id, rule, at, joint, tag, id, classes, steps, weight, declared): compounds of the selectors of a page's rules, from
    the last one (at 0) to the first; joint tells how a compound stands above the one before. weight: specificity."""
    styles = nodes.filter("tag = 'style'").select("page_id", F.col("t_from").alias("t"), "t_to").filter("t_to > t")
    # Texts that name no such property are left out before they meet the style elements.
    texts = nodes.filter((F.col("tag") == TEXT) & F.col("text").rlike(r"(?i)\{[^}]*(?:display|visibility|position|clip)")).select("page_id", F.col("t_from").alias("t"), "text").join(styles, ["page_id", "t"])
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", "")
    each = texts.withColumn("body", F.regexp_extract_all(plain, F.lit(r"([^{}]+\{[^{}]*)\}"), F.lit(1))).select("page_id", "t", F.posexplode("body").alias("n", "body"))
    each = each.select("page_id", "t", "n", F.split("body", r"\{", 2).alias("b")).select("page_id", "t", "n", declarations(F.col("b")[1]).alias("declared"), F.posexplode(F.split(F.col("b")[0], ",")).alias("m", "selector")).filter(F.size("declared") > 0)
    each = each.withColumn("selector", F.trim(F.regexp_replace("selector", r"\s+", " "))).filter((F.col("selector") != "") & F.col("selector").rlike(_PLAIN))
    spaced = F.regexp_replace("selector", r"\s*>\s*", " >")
    parts = each.withColumn("parts", F.reverse(F.split(spaced, " ")))
    order = F.struct("t", "n", "m")
    named = parts.select("page_id", F.xxhash64(order).alias("rule"), order.alias("order"), "declared", F.size("parts").alias("steps"), "selector", "parts", F.posexplode("parts").alias("at", "part"))
    bare = F.regexp_replace("part", "^>", "")
    count = lambda pattern: F.regexp_count("selector", F.lit(pattern))
    weight = F.struct((count(r"#[\w-]+") * 1_000_000 + count(r"\.[\w-]+") * 1_000 + count(r"(?:^|[\s>])[\w-]+")).alias("specific"), "order")
    above = F.when(F.col("at") > 0, F.get("parts", F.col("at") - 1).startswith(">")).otherwise(False)
    tag = F.regexp_extract(bare, r"^([\w-]+)", 1)
    return named.select("page_id", "rule", "at", above.alias("joint"), F.lower(tag).alias("tag"), F.regexp_extract(bare, r"#([\w-]+)", 1).alias("id"), F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"), "steps", weight.alias("weight"), "declared")


def _matching(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, rule, at, seq, end, parent): the elements that each compound describes, looked up by its rarest kind of name."""
    key = F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).when(F.size("classes") > 0, F.concat(F.lit("."), F.col("classes")[0])).when(F.col("tag") != "", F.col("tag")).otherwise("*")
    own = F.array_distinct(F.split(attr("class"), r"\s+"))
    keys = F.array_union(F.array(F.concat(F.lit("#"), attr("id")), F.col("tag"), F.lit("*")), F.transform(own, lambda c: F.concat(F.lit("."), c)))
    elements = nodes.join(wanted.select("page_id").distinct(), "page_id", "left_semi").filter("NOT is_text")
    keyed = elements.select("page_id", "seq", "end", "parent", F.col("tag").alias("__tag"), attr("id").alias("__id"), own.alias("__own"), F.explode(keys).alias("key"))
    met = wanted.withColumn("key", key).join(keyed, ["page_id", "key"])
    fits = ((F.col("tag") == "") | (F.col("tag") == F.col("__tag"))) & ((F.col("id") == "") | (F.col("id") == F.col("__id"))) & (F.size(F.array_except("classes", "__own")) == 0)
    return met.filter(fits).select("page_id", "rule", "at", "joint", "steps", "seq", "end", "parent")


def applied(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, seq, property, value, important, weight) of the rules' declarations for elements."""
    met = stored(_matching(nodes, found), "met")
    most = found.agg(F.max("steps")).first()[0] or 0
    # From the first compound down: what stands below elements that fit so far.
    held = met.filter(F.col("at") == F.col("steps") - 1).select("page_id", "rule", "seq", "end", "steps", "at", "joint")
    done = []
    for _ in range(most):
        done.append(held.filter("at = 0").select("page_id", "rule", "seq"))
        up = held.filter("at > 0").select("page_id", "rule", (F.col("at") - 1).alias("at"), "seq", "end", "joint")
        child = met.join(up.filter("joint").select("page_id", "rule", "at", F.col("seq").alias("parent")).distinct(), ["page_id", "rule", "at", "parent"], "left_semi")
        wide = up.filter("NOT joint")
        below = met.join(wide.select("page_id", "rule", "at").distinct(), ["page_id", "rule", "at"], "left_semi")
        both = below.withColumn("__reach", F.lit(None).cast("int")).unionByName(wide.select("page_id", "rule", "at", "seq", F.col("end").alias("__reach")), allowMissingColumns=True)
        earlier = Window.partitionBy("page_id", "rule", "at").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
        inside = both.withColumn("__far", F.max("__reach").over(earlier)).filter("__reach IS NULL AND __far > seq")
        names = ["page_id", "rule", "seq", "end", "steps", "at", "joint"]
        held = child.select(*names).unionByName(inside.select(*names))
    hits = reduce(DataFrame.unionByName, done) if done else held.select("page_id", "rule", "seq")
    said = found.filter("at = 0").select("page_id", "rule", "weight", F.explode("declared").alias("d"))
    return hits.distinct().join(said, ["page_id", "rule"]).select("page_id", "seq", "d.*", "weight")


def with_sheets(nodes: DataFrame) -> DataFrame:
    """`nodes` with the attribute hidden on the elements that their page's style sheets hide. Pages without rules that can
    hide anything are left as they are."""
    found = stored(rules(nodes), "rules")
    if found.isEmpty():
        return nodes
    given = applied(nodes, found)
    own = nodes.filter(F.map_contains_key("attrs", "style")).join(found.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "seq", F.explode(declarations(attr("style"))).alias("d")).select("page_id", "seq", "d.*")
    # An element's own style stands above all rules of equal importance.
    both = given.withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)), allowMissingColumns=True)
    best = both.groupBy("page_id", "seq").pivot("property", list(PROPERTIES)).agg(F.max_by("value", F.struct("important", "own", "weight")))
    value = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    clipped = value("clip").rlike(r"^rect\(\s*0(px)?[\s,]+0(px)?[\s,]+0(px)?[\s,]+0(px)?\s*\)$") | value("clip-path").rlike(r"^inset\(\s*(50|100)%\s*\)$")
    gone = (value("display") == "none") | value("visibility").isin("hidden", "collapse") | (value("position").isin("absolute", "fixed") & clipped)
    hits = best.filter(gone).select("page_id", "seq", F.lit(True).alias("__gone"))
    mark = F.when(F.col("__gone") & ~F.map_contains_key("attrs", "hidden"), F.map_concat("attrs", F.create_map(F.lit("hidden"), F.lit("")))).otherwise(F.col("attrs"))
    return nodes.join(hits, ["page_id", "seq"], "left").withColumn("attrs", mark).drop("__gone").select(*nodes.columns)
