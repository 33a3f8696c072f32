"""Settings and preferences on small inputs."""

from __future__ import annotations

import json

import pytest

from holdfast.functions import names
from holdfast.operators import merges, settings

CONFIG = "path_pattern string, dest_path string, output_format string, merge_mode string, config_json string"


@pytest.fixture(scope="module")
def preferences(spark):
    def make(**json_of):
        config = spark.createDataFrame([(k.upper(), None, None, None, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in json_of.items()], CONFIG)
        collections = spark.createDataFrame([(k, k.upper()) for k in json_of], "coll string, name string")
        return settings.preferences(collections, config)

    return make


def test_defaults_and_own_values(preferences):
    got = {r.coll: r for r in preferences(a=None, b={"one_g_one_r": True, "region_priority": ["Japan"], "prefer_verified": False}, c="no json", d={"exclude_prereleases": True}).collect()}
    assert got["a"].region_priority == list(names.REGIONS) == got["c"].region_priority and not got["a"].one_g_one_r
    assert (got["b"].one_g_one_r, got["b"].region_priority, got["b"].prefer_verified, got["b"].exclude_modified, got["b"].prefer_parent) == (True, ["Japan"], False, True, True)
    assert got["d"].exclude_prereleases and got["d"].exclude_bad_dumps


VARIANTS = ["T (USA)", "T (Japan)", "T (Europe) [!]", "T (Japan) [b]", "T (World) (Beta)", "T (USA) [h]"]


@pytest.mark.parametrize(
    ("wanted", "parent", "best"),
    [
        ({}, None, "T (Europe) [!]"), ({"prefer_verified": False}, None, "T (World) (Beta)"), ({"prefer_verified": False, "exclude_prereleases": True}, None, "T (USA)"),
        ({"prefer_verified": False, "region_priority": ["japan"]}, None, "T (Japan)"), ({}, "T (USA)", "T (USA)"), ({}, "T (Japan) [b]", "T (Europe) [!]"),
        ({"exclude_bad_dumps": False}, "T (Japan) [b]", "T (Japan) [b]"), ({"region_priority": ["Spain"], "prefer_verified": False, "exclude_prereleases": True}, None, "T (Europe) [!]"),
    ],
)
def test_one_variant(spark, preferences, wanted, parent, best):
    games = spark.createDataFrame([("a", g, g == parent) for g in VARIANTS], "coll string, game string, is_parent boolean")
    assert [r.game for r in names.preferred_games(games, preferences(a={"one_g_one_r": True} | wanted)).collect()] == [best]


def test_rows_of_the_variant(spark, preferences):
    rows = [("a", g, False, rom) for g in ("T (USA)", "T (Japan)", "U (Japan) [b]") for rom in ("2", "1")] + [("b", "T (Japan)", False, "x"), ("b", "T (USA)", False, "y")]
    df, own = spark.createDataFrame(rows, "coll string, game string, is_parent boolean, rom string"), preferences(a={"one_g_one_r": True}, b={})
    free = {("b", "T (Japan)", "x"), ("b", "T (USA)", "y")}
    as_set = lambda mode: {(r.coll, r.game, r.rom) for r in names.one_per_title(df, own, mode).collect()}
    assert as_set("game") == free | {("a", "T (USA)", "1"), ("a", "T (USA)", "2")} and as_set("row") == free | {("a", "T (USA)", "1")}
    with pytest.raises(ValueError, match="game or row"):
        names.one_per_title(df, own, "all")


def test_changes_merge_into_what_is_there(spark):
    config = spark.createDataFrame([("A", "/a", "zip", None, '{"region_priority":["UK"],"exclude_modified":false}'), ("B", None, None, "split", None)], CONFIG)
    rows = [("A", "1g1r", "Enable"), ("A", "regions", "France, Spain ,"), ("A", "regions", ","), ("A", "dest_path", "/first"), ("A", "dest_path", "/second"), ("B", "output_format", "tar"), ("B", "merge_mode", "MERGED"), ("C", "exclude_prereleases", "yes"), ("C", "exclude_prereleases", "enable"), ("D", "what", "x")]
    changes = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path_pattern string, key string, value string, seq int")
    got = {r.path_pattern: r for r in settings.changed(config, changes, "seq").collect()}
    assert set(got) == {"A", "B", "C"} and (got["A"].dest_path, got["A"].output_format) == ("/second", "zip") and (got["B"].merge_mode, got["B"].config_json) == ("MERGED", None)
    assert json.loads(got["A"].config_json) == settings.DEFAULTS | {"one_g_one_r": True, "region_priority": ["France", "Spain"], "exclude_modified": False}
    assert json.loads(got["C"].config_json) == settings.DEFAULTS | {"exclude_prereleases": True}
    errors = [r.error for r in settings.judged(changes).orderBy("seq").collect()]
    assert [e for e in errors if e] == ["at least one region is required", "invalid output_format: tar", "invalid exclude_prereleases: enable", "unknown key: what"]


def test_selectors(spark):
    rows = spark.createDataFrame([(5, "/a+-5"), (6, "/b5")], "id long, path string")
    pick = lambda s: {r.id for r in rows.where(merges.selected(rows, s)).collect()}
    assert (pick("5"), pick("+6"), pick("-5"), pick("+-5"), pick("b")) == ({5}, {6}, set(), {5}, {6})


def test_defaults_of_a_file():
    assert settings.defaults('default_dest_path = "/lib"\ndefault_merge_mode = "split"\nother = 1') == settings.Defaults("/lib", "torrentzip", "split")
    assert settings.defaults("") == settings.Defaults()
    with pytest.raises(ValueError, match="no such format"):
        settings.defaults('default_output_format = "rar"')
