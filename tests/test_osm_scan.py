import pytest

from wayweft.sources import osm

NODES = 400


def document(first):
    """Nodes, ways and relations; long ones reach over several ranges of a few thousand bytes."""
    nodes = "".join(f"<node id='{first + i}' lat=\"{i / 100}\" lon='1.5'><tag k='name' v='A &amp; &lt;b&gt; é > {i}'/><tag k='name' v='N{i}'/></node>\n" if i % 3 else f'  <node id="{first + i}" lon="{i / 10}" lat="2"/>' for i in range(NODES))
    odd = f'<node id="x" lat="1" lon="1"/><node id="{first + 9000}" lat="1"/><node id="{first + 9001}" lat="1" lon="no"/><!-- <node id="{first + 9002}" lat="1" lon="1"/> -->'
    way = f'<way id="{first + 1}">' + "".join(f'<nd ref="{first + i % NODES}"/>' for i in range(2000)) + '<tag k="highway" v="path"/></way>'
    empty = f'<way id="{first + 2}"><tag k="highway" v="path"/></way>'
    relation = f'<relation id="{first + 3}"><member type="node" ref="1" role="x"/>' + "".join(f'<member type="way" ref="{i}" role="{"inner" if i % 2 else ""}"/>' for i in range(50)) + '<tag k="type" v="multipolygon"/></relation>'
    other = f'<relation id="{first + 4}"><member type="way" ref="1"/><tag k="type" v="route"/></relation><changeset id="7"><tag k="a" v="b"/></changeset>'
    return f"<?xml version='1.0' encoding='UTF-8'?>\n<osm version=\"0.6\"><bounds minlat=\"0\"/>{nodes}{odd}\n{way}{empty}{relation}{other}</osm>\n"


@pytest.mark.parametrize("size", ["128m", "3000", "700"])
def test_roots_ranges_and_files(spark, tmp_path, size):
    """Several documents in a file, files in many ranges, elements that reach over ranges, and the order of all."""
    (tmp_path / "a.osm").write_text(document(10_000) + document(20_000))
    (tmp_path / "b.osm").write_text(document(30_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        found = osm.scan(spark, str(tmp_path))
        nodes, ways, relations = (sorted(x.collect(), key=lambda r: r.pos) for x in (found.nodes, found.ways, found.relations))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    firsts = (10_000, 20_000, 30_000)
    assert [r.id for r in nodes] == [f + i for f in firsts for i in range(NODES)]
    assert [(r.lon, r.lat, r.tags) for r in nodes[:3]] == [(0.0, 2.0, {}), (1.5, 0.01, {"name": "N1"}), (1.5, 0.02, {"name": "N2"})]
    assert [(r.id, r.nds, r.tags) for r in ways] == [(f + 1, [f + i % NODES for i in range(2000)], {"highway": "path"}) for f in firsts]
    assert [(r.id, [(m.ref, m.role) for m in r.members]) for r in relations] == [(f + 3, [(i, "inner" if i % 2 else "") for i in range(50)]) for f in firsts]
    assert len({r.pos for r in [*nodes, *ways, *relations]}) == len(nodes) + 6


def test_broken_and_empty(spark, tmp_path):
    (tmp_path / "empty.osm").write_text("<osm></osm>")
    assert osm.scan(spark, str(tmp_path / "empty.osm")).nodes.collect() == []
    (tmp_path / "broken.osm").write_text('<osm><node id="1" lat="1" lon="1"><tag k="a" v="b"></node><node id="2" lat="1" lon="1"/></osm>')
    with pytest.raises(Exception, match="mismatched tag"):
        osm.scan(spark, str(tmp_path / "broken.osm"))
