"""Relational queries and row changes of a pin-board application over its ten tables.

``tables`` maps table names (category, comment, corkboard, follow, likes, privatecorkboard, pushpin, tag, user, watch) to
DataFrames.  A board is private if it has a row in ``privatecorkboard``.  Parameters are values, never query text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.text import like_any, name_list, site, tag_list

Tables = dict[str, DataFrame]
BOARD = ["corkBoardID", "email", "cat_name", "title", "last_update"]


def public_boards(t: Tables) -> DataFrame:
    return t["corkboard"].join(t["privatecorkboard"].select("corkBoardID"), "corkBoardID", "left_anti")


def private_boards(t: Tables) -> DataFrame:
    return t["corkboard"].join(t["privatecorkboard"].select("corkBoardID", "password"), "corkBoardID")


def recent_feed(t: Tables, email: str, n: int = 4) -> DataFrame:
    """The ``n`` boards last updated among those a user follows, watches or owns; passwords of private ones.

    A private board that is watched comes without a password, apart from its row as an owned or followed one.
    """
    names = t["user"].select("email", "name")
    follows = t["follow"].where(F.col("email") == email).select(F.col("owner_email").alias("email"))
    watches = t["watch"].where(F.col("email") == email).select("corkBoardID")
    no_password = lambda df: df.select(*BOARD, F.lit(None).cast("string").alias("password"))
    private, public = private_boards(t).select(*BOARD, "password"), no_password(public_boards(t))
    own = F.col("email") == email
    parts = [private.join(follows, "email"), public.join(follows, "email"), no_password(t["corkboard"].join(watches, "corkBoardID")), private.where(own), public.where(own)]
    feed = parts[0].select(*BOARD, "password")
    for p in parts[1:]:
        feed = feed.unionByName(p.select(*BOARD, "password"))
    return feed.join(names, "email").select(*BOARD, "password", "name").distinct().orderBy(F.col("last_update").desc_nulls_last(), "corkBoardID", F.col("password").asc_nulls_last()).limit(n)


def my_boards(t: Tables, email: str) -> DataFrame:
    """A user's boards by title with their number of pins and, if private, the password."""
    mine = t["corkboard"].where(F.col("email") == email)
    pins = t["pushpin"].join(mine.select("corkBoardID"), "corkBoardID", "left_semi").groupBy("corkBoardID").agg(F.count("pushPinID").alias("pins"))
    out = mine.join(t["privatecorkboard"].select("corkBoardID", "password"), "corkBoardID", "left").join(pins, "corkBoardID", "left")
    return out.select("corkBoardID", F.coalesce("pins", F.lit(0)).alias("pins"), "title", "password").orderBy("title", "corkBoardID")


def popular_tags(t: Tables, n: int = 5) -> DataFrame:
    """The most used tags: pins, and boards that hold such pins."""
    used = t["tag"].join(t["pushpin"].select("pushPinID", "corkBoardID"), "pushPinID")
    return used.groupBy("tag").agg(F.count("pushPinID").alias("pins"), F.count_distinct("corkBoardID").alias("boards")).orderBy(F.desc("pins"), "tag").limit(n)


def popular_sites(t: Tables, n: int = 4) -> DataFrame:
    """The hosts with the most pins."""
    return t["pushpin"].groupBy(site(F.col("image_URL")).alias("site")).agg(F.count("pushPinID").alias("pins")).orderBy(F.desc("pins"), "site").limit(n)


def board_stats(t: Tables) -> DataFrame:
    """Every user's public and private boards and pins, in one pass over boards with their pin counts."""
    pins = t["pushpin"].groupBy("corkBoardID").agg(F.count("pushPinID").alias("pins"))
    boards = t["corkboard"].select("corkBoardID", "email").join(t["privatecorkboard"].select("corkBoardID", F.lit(True).alias("private")), "corkBoardID", "left").join(pins, "corkBoardID", "left")
    private, n = F.coalesce("private", F.lit(False)), F.coalesce("pins", F.lit(0))
    count = lambda flag, what: F.sum(F.when(flag, what).otherwise(0))
    per_user = boards.groupBy("email").agg(
        count(~private, 1).alias("public_boards"), count(~private, n).alias("public_pins"), count(private, 1).alias("private_boards"), count(private, n).alias("private_pins")
    )
    cols = ["public_boards", "public_pins", "private_boards", "private_pins"]
    out = t["user"].select("email", "name").join(per_user, "email", "left")
    return out.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols]).orderBy(F.desc("public_boards"), F.desc("private_boards"), F.desc("public_pins"), F.desc("private_pins"), "name")


def search(t: Tables, term: str) -> DataFrame:
    """Pins of public boards found by category, description or tag, without regard to case, by description.

    Finding by category needs a private board to exist somewhere.
    """
    public = public_boards(t).select("corkBoardID", "email", "cat_name", "title")
    pins = t["pushpin"].select("pushPinID", "corkBoardID", "description", "image_URL")
    any_private = t["privatecorkboard"].select(F.lit(1).alias("one")).limit(1)
    by_category = public.where(like_any(F.col("cat_name"), term)).withColumn("one", F.lit(1)).join(any_private, "one", "left_semi").drop("one")
    tagged = t["tag"].where(like_any(F.col("tag"), term)).select("pushPinID")
    found = pins.join(by_category, "corkBoardID").unionByName(pins.where(like_any(F.col("description"), term)).join(public, "corkBoardID"))
    found = found.unionByName(pins.join(tagged, "pushPinID", "left_semi").join(public, "corkBoardID"))
    out = found.join(t["user"].select("email", "name"), "email").select("pushPinID", "description", "image_URL", "title", "name")
    return out.distinct().orderBy(F.col("description").asc_nulls_first(), "pushPinID")


def pin_likers(t: Tables, pin: int) -> DataFrame:
    """Names of those who like a pin, as one text."""
    liked = t["likes"].where(F.col("pushPinID") == pin).join(t["user"], "email")
    return liked.agg(name_list(F.array_sort(F.collect_list("name"))).alias("names"))


def pin_comments(t: Tables, pin: int) -> DataFrame:
    """Comments on a pin with their authors' names, latest first."""
    return t["comment"].where(F.col("pushPinID") == pin).join(t["user"].select("email", "name"), "email").select("name", "content", "added_time", "commentID").orderBy(F.desc("added_time"), "commentID")


def watchers(t: Tables, board: int) -> DataFrame:
    return t["watch"].where(F.col("corkBoardID") == board).agg(F.count("*").alias("watchers"))


def board_page(t: Tables, board: int, viewer: str) -> DataFrame:
    """One row: the board, its owner, whether it is private, watched or followed by the viewer, watchers, pins."""
    one = t["corkboard"].where(F.col("corkBoardID") == board).join(t["user"].select("email", "name"), "email")
    flag = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    out = one.join(flag(t["privatecorkboard"], ["corkBoardID"], "private"), "corkBoardID", "left")
    out = out.join(flag(t["watch"].where(F.col("email") == viewer), ["corkBoardID"], "watched"), "corkBoardID", "left")
    follows = t["follow"].where(F.col("email") == viewer).select(F.col("owner_email").alias("email")).distinct().withColumn("followed", F.lit(True))
    out = out.join(follows, "email", "left")
    for name, df in (("watchers", t["watch"]), ("pins", t["pushpin"])):
        out = out.join(df.where(F.col("corkBoardID") == board).groupBy("corkBoardID").agg(F.count("*").alias(name)), "corkBoardID", "left")
    return out.select(*BOARD, "name", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("private", "watched", "followed")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("watchers", "pins")])


def pin_page(t: Tables, pin: int, viewer: str) -> DataFrame:
    """One row: the pin, its board, owner and host, its tags and likers as texts, its number of comments, and whether
    the viewer likes it, owns it or follows its owner."""
    one = t["pushpin"].where(F.col("pushPinID") == pin)
    page = one.join(t["corkboard"].select("corkBoardID", "email", "title", F.col("last_update").alias("board_update")), "corkBoardID").join(t["user"].select("email", F.col("name").alias("owner")), "email")
    tags = t["tag"].where(F.col("pushPinID") == pin).agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    comments = t["comment"].where(F.col("pushPinID") == pin).agg(F.count("*").alias("comments"))
    liked = t["likes"].where((F.col("pushPinID") == pin) & (F.col("email") == viewer)).agg((F.count("*") > 0).alias("liked"))
    followed = t["follow"].where(F.col("email") == viewer).select(F.col("owner_email").alias("email")).distinct().withColumn("followed", F.lit(True))
    page = page.join(followed, "email", "left")
    for part in (tags, pin_likers(t, pin).withColumnRenamed("names", "likers"), comments, liked):
        page = page.join(F.broadcast(part))  # one row each
    return page.select(
        "pushPinID", "corkBoardID", "title", "board_update", "owner", "description", "image_URL", site(F.col("image_URL")).alias("site"), "tags", "likers", "comments", "liked",
        (F.col("email") == viewer).alias("own"), F.coalesce("followed", F.lit(False)).alias("followed"),
    )


def next_ids(rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the greatest id, in an order, by ranges of it."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    return numbered(rows, "__n", *map(F.col, order)).join(F.broadcast(top)).withColumn(key, (F.col("__top") + F.col("__n")).cast("long")).drop("__top", "__n")


def insert(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return table.unionByName(next_ids(rows, table, key, order).select(*table.columns))


def insert_absent(table: DataFrame, rows: DataFrame, on: list[str], key: str) -> DataFrame:
    """Appends the rows whose ``on`` columns do not occur yet, each once."""
    new = rows.dropDuplicates(on).join(table.select(*on), on, "left_anti")
    return insert(table, new, key, on)


def toggle(table: DataFrame, rows: DataFrame, on: list[str], key: str) -> DataFrame:
    """Removes the rows that occur and appends those that do not."""
    rows = rows.dropDuplicates(on)
    kept = table.join(rows.select(*on), on, "left_anti").select(*table.columns)
    new = rows.join(table.select(*on), on, "left_anti")
    return kept.unionByName(next_ids(new, table, key, on).select(*table.columns))


def add_tags(t: Tables, pins: DataFrame) -> DataFrame:
    """The tag table with the tags of new pins (``pushPinID, tags`` as comma-separated text)."""
    rows = pins.select("pushPinID", F.explode(tag_list(F.col("tags"))).alias("tag"))
    return insert(t["tag"], rows, "tagID", ["pushPinID", "tag"])


def touch_boards(boards: DataFrame, changed: DataFrame, at) -> DataFrame:
    """Sets ``last_update`` of the boards in ``changed`` (for either boards table)."""
    hit = changed.select("corkBoardID").distinct().withColumn("__hit", F.lit(True))
    return boards.join(hit, "corkBoardID", "left").withColumn("last_update", F.when(F.col("__hit"), at).otherwise(F.col("last_update"))).select(*boards.columns)


def register_check(t: Tables, rows: DataFrame) -> DataFrame:
    """New users with ``email_taken`` and ``name_taken``."""
    email, name = (t["user"].select(c).distinct().withColumn(f"{c}_taken", F.lit(True)) for c in ("email", "name"))
    out = rows.join(email, "email", "left").join(name, "name", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("email_taken", "name_taken")})


def opens(t: Tables, board: int, password: str) -> DataFrame:
    """Whether a password opens a private board: one row."""
    return t["privatecorkboard"].where(F.col("corkBoardID") == board).agg(F.coalesce(F.max(F.col("password") == password), F.lit(False)).alias("opens"))
