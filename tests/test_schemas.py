from palimpsest.schemas import SCHEMAS, schema


def test_schemas_parse(spark):
    for name in SCHEMAS:
        assert len(schema(name)) == SCHEMAS[name].count(",") + 1
