from pyspark.sql import Row

from skeinlake.operators.nested import Child, TaggedTables, emit_tagged, plan_children

SCHEMA = "row_id bigint, pos int, tag string, images array<struct<image:string,view:string,boxes:array<struct<n:int,m:map<string,int>>>>>, flags struct<a:boolean,b:boolean,c:boolean>"


def _df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_positions_nulls_hollow_and_repeats(spark, rows):
    a, b = ("x.jpg", "ANT", None), ("y.jpg", None, None)
    df = _df(spark, [
        (1, 7, "clash", [None, a, (None, None, None), a, b], (True, None, False)),
        (2, None, None, [], None), (3, None, None, None, (False, False, True)), (None, None, None, [a], (None, None, None)),
    ])
    out = TaggedTables(spark, df, "row_id", (Child("images", "image"), Child("flags", "output", "flags")))
    assert rows(out.links()) == sorted([(1, "image", 1), (1, "image", 4), (1, "output", 0), (3, "output", 2), (None, "image", 0)], key=lambda t: tuple((v is None, str(v)) for v in t))
    image = {(r.row_id, r.pos): (r.image, r.view, r.parent_pk, r.pk) for r in out.table("image").collect()}
    assert image[(1, 4)] == ("y.jpg", None, "1", "1/image/4")
    assert {r.member for r in out.table("output").where("row_id = 3").collect()} == {"c"}


def test_children_of_children_keep_their_links(spark):
    df = _df(spark, [(5, 1, "t", [("x", "ANT", [(1, {"k": 1}), (1, {"k": 1}), (2, None)]), ("z", "POST", None)], None)])
    out = TaggedTables(spark, df, "row_id", plan_children(df.schema))
    boxes = {r.pk: (r.parent_pk, r.n) for r in out.table("images_boxes").collect()}
    assert boxes == {"5/images/0/images_boxes/0": ("5/images/0", 1), "5/images/0/images_boxes/2": ("5/images/0", 2)}
    assert {r.pk for r in out.table("images").collect()} == {"5/images/0", "5/images/1"}


def test_empty_table_keeps_schema(spark):
    out = TaggedTables(spark, _df(spark, []), "row_id", (Child("images", "image"),))
    assert out.table("image").columns == ["row_id", "pk", "parent_pk", "pos", "image", "view", "boxes"]
    assert out.links().count() == 0


def test_long_array_and_one_scan(spark):
    many = [Row(image=str(i % 500), view="ANT", boxes=None) for i in range(5000)]
    df = _df(spark, [(1, 0, "", many, None)])
    out = emit_tagged(df, "row_id", (Child("images", "image"), Child("flags", "output", "flags")))
    assert out.count() == 500
    assert sum(r.pos for r in out.collect()) == sum(range(500))
