"""Pages derived from entries, their index, and the integrity of what they link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import front_matter_field, links_of, slugify, strip, with_references, yaml_list, yaml_quoted
from millrace.plans.session import written


def entry_slugs(entries: DataFrame) -> DataFrame:
    """(entry_id, slug): the slug of the title, of the id where the title has none.

    Of entries with one slug the earliest by (created_at, entry_id) keeps it; the others get the last six characters of
    their id behind it, and two more for each entry before them that would still have the same.
    """
    rows = entries.select("entry_id", "source.title", "meta.created_at").distinct()
    base = F.coalesce(F.nullif(slugify(F.coalesce("title", F.lit(""))), F.lit("")), F.col("entry_id"))
    # The first of a slug is a minimum, so a title that very many share is no window of its own.
    named = rows.withColumn("base", base)
    firsts = named.groupBy("base").agg(F.min(F.struct("created_at", "entry_id")).alias("first"))
    ranked = named.join(firsts, "base").withColumn("nth", F.when(F.col("first.entry_id") == F.col("entry_id"), 1).otherwise(2))
    short = F.concat_ws("-", "base", slugify(F.right("entry_id", F.lit(6))))
    again = ranked.withColumn("short", F.when(F.col("nth") == 1, F.col("base")).otherwise(short)).withColumn("k", F.row_number().over(Window.partitionBy("short").orderBy("nth", "created_at", "entry_id")))
    longer = F.concat_ws("-", "base", slugify(F.right("entry_id", F.lit(6) + (F.col("k") - 1) * 2)))
    return again.select("entry_id", F.when(F.col("k") == 1, F.col("short")).otherwise(longer).alias("slug"))


def source_pages(entries: DataFrame) -> DataFrame:
    """(dir, slug, body): a page for each entry with front matter, takeaway, key points and related pages."""
    one = entries.select("entry_id", "source", "tags", "distilled_note", "related_entries", "meta").distinct()
    slugs = entry_slugs(entries)
    targets = slugs.select(F.col("entry_id").alias("target"), F.col("slug").alias("target_slug"))
    related = (
        one.select("entry_id", F.posexplode("related_entries").alias("pos", "r")).select("entry_id", "pos", "r.*").join(targets, "target", "left")
        .groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.format_string("- %s: [%s](%s.md)", "relation", "target", F.coalesce("target_slug", "target")).alias("line")))).alias("lines"))
        .select("entry_id", F.transform("lines", lambda x: x["line"]).alias("related"))
    )
    points = F.transform(F.coalesce(F.col("distilled_note.key_points"), F.array()), lambda p: F.concat(F.lit("- "), with_references(p["text"], p["item_ids"])))
    lines = F.flatten(F.array(
        F.array(F.lit("---"), F.lit("type: source"), F.concat(F.lit("title: "), yaml_quoted(F.coalesce("source.title", F.lit("")))), F.concat(F.lit("entry_id: "), F.col("entry_id")), F.concat(F.lit("topics: "), yaml_list(F.coalesce("tags.topics", F.array()))), F.concat(F.lit("date: "), F.substring("meta.created_at", 1, 10)), F.lit("---"), F.lit("")),
        F.array(F.concat(F.lit("# "), F.coalesce("source.title", F.lit(""))), F.lit(""), F.coalesce(with_references(F.col("distilled_note.core_takeaway.text"), F.col("distilled_note.core_takeaway.item_ids")), F.lit("")), F.lit(""), F.lit("## Key points"), F.lit("")),
        points,
        F.when(F.col("related").isNull(), F.array()).otherwise(F.concat(F.array(F.lit(""), F.lit("## Related"), F.lit("")), F.col("related"))),
    ))
    body = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return one.join(slugs, "entry_id").join(related, "entry_id", "left").select(F.lit("sources").alias("dir"), "slug", body.alias("body"))


def index_lines(pages: DataFrame) -> DataFrame:
    """(dir, slug, line): one index line a page; the index is these lines in order of the slug, so that it grows with
    the pages as rows and not as one value."""
    title = F.coalesce(front_matter_field(F.col("body"), "title"), F.col("slug"))
    return pages.select("dir", "slug", F.concat(F.lit("- ["), title, F.lit("]("), F.col("slug"), F.lit(".md)")).alias("line"))


def lint(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Findings on a set of pages: (code, page, detail).

    pages: dir, slug, body; listed: dir, slug of what the directory's index lists. E1 no type in the front matter; E2 a
    link to a page that isn't there; E3 a source, E5 a concept, E9 an entity that isn't listed; E4 a source without raw
    transcript or the reverse; E5b a concept, E9b an entity of another type; E6 and E10 a concept or entity whose videos
    or cited sources don't exist or don't agree; E7 and E11 a link between concept or entity and source without one
    back; E8 and E12 a concept or entity that nothing links to.
    """
    def field(name: str) -> Column:
        return front_matter_field(F.col("body"), name)

    def under(heading: str, directory: str) -> Column:
        after = F.when(F.contains("body", F.lit(heading)), F.substring(F.col("body"), F.instr("body", heading), F.length("body"))).otherwise("")
        paths = F.filter(links_of(after), lambda x: x.contains(f"{directory}/") & x.endswith(".md"))
        return F.array_distinct(F.transform(paths, lambda x: F.regexp_extract(x, rf"{directory}/([^/]+)\.md$", 1)))

    videos = F.filter(F.split(F.regexp_replace(F.coalesce(field("videos"), F.lit("")), r"^\[|\]$", ""), r"\s*,\s*"), lambda v: v != "")
    # What the findings are made of is read out of the pages once; their texts aren't read again.
    p = written(pages.select(
        "dir", "slug", F.concat_ws("/", "dir", "slug").alias("page"), field("type").alias("type"), F.when(F.col("dir") != "raw", links_of(F.col("body"))).alias("links"),
        *(F.when(F.col("dir").isin("concepts", "entities"), x).alias(n) for x, n in ((videos, "videos"), (under("## Sources", "sources"), "cites"))),
        *(F.when(F.col("dir") == "sources", under(f"## {n.capitalize()} covered", n)).alias(n) for n in ("concepts", "entities")),
    ))
    out = lambda df, code, detail=None: df.select(F.lit(code).alias("code"), "page", (F.lit("") if detail is None else detail).alias("detail"))
    found = out(p.filter("type is null"), "E1")
    link = p.select("dir", "page", F.explode("links").alias("link"))
    resolved = F.regexp_replace(F.when(F.col("link").startswith("../"), F.substring("link", 4, 1_000_000)).otherwise(F.concat_ws("/", "dir", "link")), r"\.md$", "")
    to_page = link.withColumn("target", resolved).filter(~F.col("link").endswith("index.md"))
    found = found.unionAll(out(to_page.join(p.select(F.col("page").alias("target")), "target", "left_anti"), "E2", F.col("link")))
    code = F.create_map(*(F.lit(x) for pair in (("sources", "E3"), ("concepts", "E5"), ("entities", "E9")) for x in pair))
    unlisted = p.filter(F.col("dir") != "raw").join(listed.select("dir", "slug"), ["dir", "slug"], "left_anti")
    found = found.unionAll(unlisted.select(F.element_at(code, F.col("dir")).alias("code"), "page", F.lit("").alias("detail")))
    sides = p.filter("dir in ('sources', 'raw')").groupBy("slug").agg(F.max("page").alias("page"), F.countDistinct("dir").alias("n"))
    found = found.unionAll(out(sides.filter("n = 1"), "E4"))
    sources = p.filter("dir = 'sources'")
    for directory, kind, codes in (("concepts", "concept", ("E5b", "E6", "E7", "E8")), ("entities", "entity", ("E9b", "E10", "E11", "E12"))):
        own = p.filter(F.col("dir") == directory)
        found = found.unionAll(out(own.filter(F.coalesce("type", F.lit("")) != kind), codes[0]))
        video = own.select("page", F.explode("videos").alias("video"))
        found = found.unionAll(out(video.join(sources.select(F.col("slug").alias("video")), "video", "left_anti"), codes[1], F.concat(F.lit("video "), "video")))
        cites = own.select("page", F.explode(F.array_except("cites", "videos")).alias("other"))
        found = found.unionAll(out(cites, codes[1], F.concat(F.lit("cites "), "other")))
        # Links from here to a source and back, met in one aggregation.
        forth = own.select(F.col("slug").alias("a"), F.explode("cites").alias("b"), F.lit(1).alias("side"))
        back = sources.select(F.explode(directory).alias("a"), F.col("slug").alias("b"), F.lit(2).alias("side"))
        one_way = forth.unionAll(back).groupBy("a", "b").agg(F.min("side").alias("side"), F.max("side").alias("other")).filter("side = other")
        detail = F.concat(F.when(F.col("side") == 1, "no link back from ").otherwise("doesn't cite back "), "b")
        found = found.unionAll(one_way.select(F.lit(codes[2]).alias("code"), F.concat_ws("/", F.lit(directory), "a").alias("page"), detail.alias("detail")))
        peers = to_page.filter((F.col("dir") == directory) & F.col("target").startswith(directory + "/")).select(F.col("target").alias("page"))
        inbound = back.select(F.concat_ws("/", F.lit(directory), "a").alias("page")).unionAll(peers)
        found = found.unionAll(out(own.join(inbound, "page", "left_anti"), codes[3]))
    return found.distinct()


def group_pages(members: DataFrame, directory: str) -> DataFrame:
    """(dir, slug, body): a page for each concept or entity with its sources. members: slug, title, type, source (slug of
    a source page), quote (or null), listed BOOLEAN (whether the page cites the source or only names it). A null type
    gives a page without one."""
    line = F.when(F.col("listed"), F.concat(F.lit("- ["), "source", F.lit("](../sources/"), "source", F.lit(".md)"), F.coalesce(F.concat(F.lit(': "'), "quote", F.lit('"')), F.lit(""))))
    each = members.groupBy("slug", "source").agg(F.min("title").alias("title"), F.min("type").alias("type"), F.min(line).alias("line"))
    of = each.groupBy("slug").agg(F.min("title").alias("title"), F.min("type").alias("type"), F.array_sort(F.collect_list(F.struct("source", "line"))).alias("l"))
    body = F.concat(
        F.lit("---\n"), F.coalesce(F.concat(F.lit("type: "), "type", F.lit("\n")), F.lit("")), F.lit("title: "), yaml_quoted(F.col("title")), F.lit("\nvideos: "), yaml_list(F.transform("l", lambda x: x["source"])),
        F.lit("\n---\n\n# "), "title", F.lit("\n\n## Sources\n\n"), F.array_join(F.transform(F.filter("l", lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n"), F.lit("\n"),
    )
    return of.select(F.lit(directory).alias("dir"), "slug", body.alias("body"))


def with_backlinks(sources: DataFrame, covered: DataFrame) -> DataFrame:
    """Source pages with the concepts and entities that they cover. covered: slug (of the source), dir, target."""
    line = F.concat(F.lit("- ["), "target", F.lit("](../"), "dir", F.lit("/"), "target", F.lit(".md)"))
    lines = lambda d: F.array_join(F.array_sort(F.collect_list(F.when(F.col("dir") == d, line))), "\n")
    each = covered.select("slug", "dir", "target").distinct().groupBy("slug").agg(lines("concepts").alias("c"), lines("entities").alias("e"))
    section = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n## {name} covered\n\n"), F.col(c), F.lit("\n"))).otherwise("")
    return sources.join(each, "slug", "left").select("dir", "slug", F.concat("body", section("Concepts", "c"), section("Entities", "e")).alias("body"))


def raw_heads(slugs: DataFrame) -> DataFrame:
    """(dir, slug, body): the head of each raw transcript page; its lines are rows of their own, however many."""
    return slugs.select(F.lit("raw").alias("dir"), "slug", F.concat(F.lit("---\ntype: raw-transcript\n---\n\n# "), "slug", F.lit("\n\n## Transcript\n")).alias("body"))


def without_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages without the given ones (dir, slug); what isn't there can be named."""
    return pages.join(gone.select("dir", "slug").distinct(), ["dir", "slug"], "left_anti")


def bundle_index(pages: DataFrame) -> DataFrame:
    """(dir, nth, line): the index of each directory as lines: sources in order of slug, concepts and entities of their
    lower-cased title, then slug; and of the root ('') one line for each directory with its number of pages. Raw pages
    are in no index."""
    title = F.coalesce(front_matter_field(F.col("body"), "title"), F.col("slug"))
    rows = pages.filter("dir <> 'raw'").select("dir", "slug", title.alias("title"))
    key = F.struct(F.when(F.col("dir") == "sources", F.col("slug")).otherwise(F.lower("title")), "slug")
    ordered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dir").orderBy(key))).select("dir", "nth", F.concat(F.lit("- ["), "title", F.lit("]("), "slug", F.lit(".md)")).alias("line"))
    sizes = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    root = sizes.withColumn("nth", F.row_number().over(Window.orderBy("dir"))).select(F.lit("").alias("dir"), "nth", F.concat(F.lit("- ["), "dir", F.lit("]("), "dir", F.lit("/index.md) ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return ordered.unionAll(root)


def note_markdown(parts: DataFrame, titles: DataFrame) -> DataFrame:
    """(entry_id, body): each entry's note as a teaching note: title, takeaway and one list for each section that has
    parts. parts: entry_id, section, pos, text; titles: entry_id, title."""
    heads = {"core_takeaway": "Core takeaway", "key_points": "Key points", "why_it_matters": "Why it matters", "how_to_apply": "How to apply", "caveats": "Caveats", "review_questions": "Review questions"}
    rank = F.create_map(*(x for i, name in enumerate(heads) for x in (F.lit(name), F.lit(i))))
    head = F.create_map(*(F.lit(x) for pair in heads.items() for x in pair))
    line = F.when(F.col("section") == "core_takeaway", strip(F.col("text"))).otherwise(F.concat(F.lit("- "), strip(F.col("text"))))
    rows = parts.filter(F.coalesce(strip(F.col("text")), F.lit("")) != "").select("entry_id", "section", F.element_at(rank, F.col("section")).alias("r"), "pos", line.alias("line"))
    section = rows.groupBy("entry_id", "section", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("## "), F.element_at(head, F.col("section")), F.lit("\n\n"), "lines")
    blocks = section.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return titles.join(blocks, "entry_id").select("entry_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), F.array_join("blocks", "\n\n"), F.lit("\n")).alias("body"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only; repeats count once and nulls are left out."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").filter("a is null or b is null").select(key, F.when(F.col("b").isNull(), "left only").otherwise("right only").alias("side"))


def rendered_citations(parts: DataFrame, items: DataFrame, slugs: DataFrame) -> DataFrame:
    """(entry_id, pos, text): each part with links to its items' places, '[slug @ time]', in order of citation."""
    cited = parts.select("entry_id", "pos", "text", F.posexplode(F.array_distinct("item_ids")).alias("k", "item_id"))
    place = cited.join(items.select("entry_id", "item_id", F.col("provenance.timestamp").alias("ts")), ["entry_id", "item_id"]).join(slugs, "entry_id")
    mark = F.concat(F.lit("["), F.col("slug"), F.when(F.col("ts").isNotNull(), F.concat(F.lit(" @ "), F.col("ts"))).otherwise(F.lit("")), F.lit("]"))
    marks = place.groupBy("entry_id", "pos").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("k", mark.alias("mark")))).alias("marks"))
    return marks.select("entry_id", "pos", F.concat_ws(" ", strip(F.col("text")), F.array_join(F.transform("marks", lambda m: m["mark"]), "")).alias("text"))
