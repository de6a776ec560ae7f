"""Text helpers: escaping, paths, front matter, small parsers. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.ids import strip


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def md_cell(c: Column) -> Column:
    """A value in a table row of an index: pipes escaped, line ends as spaces, blanks around it gone."""
    return strip(_replace(c, ("|", "\\|"), ("\r\n", " "), ("\n", " "), ("\r", " ")))


def bitable_cell(c: Column) -> Column:
    """A value in a rendered table: backslashes and pipes escaped, line ends as spaces, one space when empty."""
    out = _replace(c, ("\\", "\\\\"), ("|", "\\|"), ("\n", " "), ("\r", " "))
    return F.when(out == "", " ").otherwise(out)


def link_text(c: Column) -> Column:
    return _replace(c, ("[", "\\["), ("]", "\\]"))


def link_dest(path: Column) -> Column:
    """A link's target, in angle brackets when it holds a space or a parenthesis."""
    return F.when(path.rlike("[ ()]"), F.concat(F.lit("<"), path, F.lit(">"))).otherwise(path)


def yaml_quote(c: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), _replace(c, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), F.lit('"'))


def yaml_key(c: Column) -> Column:
    """A YAML key: bare when nothing in it means something to YAML and no blanks stand around it, else quoted."""
    plain = (c != "") & (strip(c) == c) & ~c.rlike(r"^[!&*\-?:,\[\]{}#|>@`\"'%]") & ~c.rlike(r"[:#\n\r\t\"\\]")
    return F.when(plain, c).otherwise(yaml_quote(c))


#: Fixed value: the first line of every front matter block.
FRONT_WARNING = "# Read-only mirror: local changes are overwritten on the next sync; to change content, follow the url and edit online"


def front_block(texts: dict[str, Column], times: dict[str, Column], properties: Column | None = None) -> Column:
    """A front matter block: the warning, ``texts`` quoted (null is empty), ``times`` as they are (null or empty is null), in the
    order of the dictionaries, then ``properties``, an array of (key, value), if there are any."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_quote(F.coalesce(c, F.lit("")))) for k, c in texts.items()]
    lines += [F.concat(F.lit(f"{k}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit("null"))) for k, c in times.items()]
    block = F.concat_ws("\n", F.lit("---"), F.lit(FRONT_WARNING), *lines)
    if properties is not None:
        each = F.transform(properties, lambda p: F.concat(F.lit("\n  "), yaml_key(p["key"]), F.lit(": "), yaml_quote(p["value"])))
        block = F.concat(block, F.when(F.size(properties) > 0, F.concat(F.lit("\nproperties:"), F.array_join(each, ""))).otherwise(""))
    return F.concat(block, F.lit("\n---\n"))


def xml_escape(c: Column) -> Column:
    return _replace(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_unescape(c: Column) -> Column:
    return _replace(c, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def first_line(c: Column) -> Column:
    return strip(F.substring_index(c, "\n", 1))


def csv_items(c: Column) -> Column:
    """The non-blank items of a comma-separated list, without blanks around them."""
    return F.filter(F.transform(F.split(c, ","), lambda x: strip(x)), lambda x: x != "")


def join_blocks(blocks: Column) -> Column:
    """The non-blank blocks with an empty line between them."""
    return F.array_join(F.filter(blocks, lambda b: strip(b) != ""), "\n\n")


def split_front_matter(c: Column) -> tuple[Column, Column]:
    """(head with both marker lines, body); the head is '' when there is none. Nothing is lost."""
    pattern = r"(?s)^(---\n.*?\n---\n)(.*)$"
    has = c.rlike(pattern)
    return F.when(has, F.regexp_extract(c, pattern, 1)).otherwise(""), F.when(has, F.regexp_extract(c, pattern, 2)).otherwise(c)


def content_path(digest: Column, ext: Column) -> Column:
    """Where content of this digest lies in the pool."""
    return F.concat(F.lit("assets/"), F.left(digest, F.lit(2)), F.lit("/"), digest, F.coalesce(ext, F.lit("")))


def relative_path(source: Column, target: Column) -> Column:
    """The path from the file ``source`` to the file ``target``, both relative to one root."""
    here, there = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    limit = F.least(F.size(here), F.size(there) - 1)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), lambda i: (i <= limit) & (F.slice(here, 1, i) == F.slice(there, 1, i))))
    return F.concat(F.repeat(F.lit("../"), F.size(here) - same), F.array_join(F.slice(there, same + 1, F.size(there)), "/"))


def container_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/README\.md$", "")


def looks_like_path(c: Column) -> Column:
    return c.rlike(r"[/\\]") | c.endswith(".md")


def first_semver(c: Column) -> Column:
    """The first version number as an array of three numbers, missing parts 0; null when there is none."""
    pattern = r"(\d+)\.(\d+)(?:\.(\d+))?"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(c.rlike(pattern), F.array(part(1), part(2), part(3)))


def clock_times(c: Column) -> Column:
    """A comma-separated list of HH:MM times: parsed, distinct, in order ('HH:MM'); null when any is none."""
    items = csv_items(c)
    good = F.forall(items, lambda x: x.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")) & (F.size(items) > 0)
    padded = F.transform(items, lambda x: F.lpad(x, 5, "0"))
    return F.when(good, F.array_sort(F.array_distinct(padded)))


def retry_after(c: Column) -> Column:
    """Seconds of a Retry-After header; 0 when it is none."""
    return F.greatest(F.coalesce(strip(c).try_cast("int"), F.lit(0)), F.lit(0))


def _bind(c: Column, f) -> Column:
    """``f`` of ``c``, evaluated once however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def number_text(x: Column) -> Column:
    """A double in plain decimal notation with the fewest digits that tell it from its neighbours, '' for null."""
    pattern = r"^(-?)(\d+)\.?(\d*)(?:E(-?\d+))?$"
    part = lambda t, i: F.regexp_extract(t, pattern, i)

    def split(t: Column) -> Column:
        """Sign, digits without zeros around them, and where the point stands before the first of them."""
        return _bind(
            F.struct(part(t, 1).alias("sign"), F.concat(part(t, 2), part(t, 3)).alias("all"), (F.length(part(t, 2)) + F.coalesce(part(t, 4).try_cast("int"), F.lit(0))).alias("point")),
            lambda p: F.struct(p["sign"].alias("sign"), F.btrim(p["all"], F.lit("0")).alias("digits"), (p["point"] - F.length(p["all"]) + F.length(F.ltrim(p["all"], F.lit("0")))).alias("point")),
        )

    def shorter(p: Column) -> Column:
        """With one digit less, where that is still the same number: the JVM may write up to two too many."""
        head = F.left(p["digits"], F.length(p["digits"]) - 1)
        up = F.lpad((head.try_cast("decimal(20,0)") + 1).cast("string"), F.length(head), F.lit("0"))
        same = lambda d: F.concat(p["sign"], F.lit("0."), d, F.lit("E"), p["point"].cast("string")).try_cast("double") == x
        first, second = (F.when(F.right(p["digits"], F.lit(1)) >= "5", c).otherwise(o) for c, o in ((up, head), (head, up)))
        digits = F.when(F.length(head) < 1, p["digits"]).when(same(first), first).when(same(second), second).otherwise(p["digits"])
        return F.struct(p["sign"].alias("sign"), F.rtrim(digits, F.lit("0")).alias("digits"), p["point"].alias("point"))

    def plain(p: Column) -> Column:
        d, at, n = p["digits"], p["point"], F.length(p["digits"])
        shown = (
            F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d))
            .when(at >= n, F.concat(d, F.repeat(F.lit("0"), at - n)))
            .otherwise(F.concat(F.left(d, at), F.lit("."), F.substring(d, at + 1, n)))
        )
        return F.when(d == "", "0").otherwise(F.concat(p["sign"], shown))

    text = _bind(_bind(_bind(split(x.cast("string")), shorter), shorter), plain)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "").otherwise(text)
