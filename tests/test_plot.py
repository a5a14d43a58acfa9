from __future__ import annotations

import json

import pytest

from rowloom.plans.parser import SyntaxProblem
from rowloom.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("sales", spark.createDataFrame([(i, f"r{i % 2}", float(i * i % 7), i % 3 == 0) for i in range(12)], "day int, region string, amount double, held boolean"))
    return e


def rows(layer, *columns):
    return sorted(tuple(r) for r in layer.df.select(*columns).collect())


def test_points_with_facets_axes_and_a_mark(engine):
    plot = engine.plot(
        "select * from sales plot(geom = scatter(x = day, y = amount * 2), fill = region scale = color('a' as 'red', 'b' as 'blue'),"
        " mark(held, size = 100)) facet(rows = region, margin) axis day (label = 'Day', scale = log(1, null), free = off)"
        " display(width = 400, margin(top = -3)) transition(duration = 10, ease = 'cubic') layout aligned"
    )
    (layers,) = plot.subplots
    own, mark = layers
    assert rows(own, "x", "y", "fill", "facet_row", "mark0") == sorted((i, 2.0 * (i * i % 7), f"r{i % 2}", f"r{i % 2}", i % 3 == 0) for i in range(12))
    assert rows(mark, "x", "size") == [(i, 100) for i in range(0, 12, 3)]
    (shown,) = plot.spec["subplots"]
    assert shown["axes"]["x"] == {"scale": {"type": "log", "domain": [1, None]}, "label": "Day", "free": False}
    assert shown["axes"]["y"]["scale"] == {"type": "linear"}
    assert shown["layers"][0]["aes"]["fill"]["scale"] == {"type": "color", "domain": ["a", "b"], "range": ["red", "blue"]}
    assert plot.spec["display"] == {"width": 400, "margin": {"top": -3}} and plot.spec["aligned"] is True
    assert plot.spec["facet"] == {"rows": True, "columns": False, "margin": True}
    assert len(plot.json()["subplots"][0]["layers"][1]["data"]) == 4
    assert [json.loads(line) for line in plot.lines()][1]["layer"] == 0


def test_bins_below_their_points_by_group(engine):
    (layers,) = engine.plot("select day as x, amount as y, region from sales plot(geom = point, group = region, stat = bin(binwidth = 4, min = 0, fill = freq))").subplots
    bins, points = layers
    assert (bins.spec["geom"], bins.spec["order"], points.spec["geom"]) == ("histogram", -1, "point")
    wanted = [(f"r{g}", low, low + 4.0, 2, 2, 2) for g in (0, 1) for low in (0.0, 4.0, 8.0)]
    assert rows(bins, "group", "xmin", "xmax", "freq", "fill", "tooltip") == wanted


def test_smooth_line_above_and_layers(engine):
    (layers,) = engine.plot("select * from sales plot(layer(geom = line(x = day, y = day), stat = loess(bandwidth = 0.5, weight = day + 1), group = region), layer(geom = hline(y = 3), hidden))").subplots
    assert [(x.spec["geom"], x.spec["hidden"]) for x in layers] == [("line", False), ("line", False), ("hline", True)]
    assert all(abs(x - y) < 1e-6 for x, y in rows(layers[1], "x", "y")) and layers[1].df.count() == 12


def test_stacked_and_dodged_bars(engine):
    query = "select region, day % 2 as d, sum(amount) as total from sales group by region, day % 2 plot(geom = bar(x = 1, y = total), group = region, position = {})"
    low = dict(engine.sql("select region, sum(amount) as t from sales group by region").collect())
    ((stacked,),) = engine.plot(query.format("stack order by region desc")).subplots
    assert rows(stacked, "group", "below", "stackindex") == [("r0", low["r1"], 1), ("r1", 0.0, 0)]
    ((dodged,),) = engine.plot(query.format("dodge(padding = 0.5)")).subplots
    assert [round(d, 9) for _, d in rows(dodged, "group", "dodge")] == [round(1 / 3, 9), round(2 / 3, 9)]


def test_lists_of_parameters_make_subplots(engine):
    plot = engine.plot("select * from sales plot(geom = point(x = (day, amount), y = (amount, day)))")
    assert [rows(layers[0], "x", "y")[-1] for layers in plot.subplots] == [(11, 2.0), (11, 11), (4.0, 4.0), (4.0, 9)]
    assert engine.plot("select * from sales plot(geom = point(x = day, y = abs(amount))) axis abs(amount) (ticks = 3)").spec["subplots"][0]["axes"]["y"]["ticks"] == 3
    assert engine.plot("select * from sales plot").spec["subplots"][0]["axes"] == {"x": {}, "y": {}}


@pytest.mark.parametrize("text", ["plot(geom = pie(x = day))", "plot(geom = point) facet(depth = day)", "plot(colour = day)", "plot(layer(geom = point(x = (day, amount))))", "plot(fill = day scale = log(1, 2, 3))"])
def test_what_is_no_plot(engine, text):
    with pytest.raises(SyntaxProblem):
        engine.plot(f"select * from sales {text}")
