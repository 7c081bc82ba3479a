"""Rows of a DataFrame against rows of SQL, without order."""


def text(value) -> str:
    if value is None or str(value) in ("nan", "<NA>", "NaT"):
        return "null"
    value = value.item() if hasattr(value, "item") else value
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def rows(frame) -> list[str]:
    return sorted("|".join(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def check(df, relation) -> int:
    got, want = df.toPandas(), relation.df()
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {c: KINDS.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types, strict=True)}
    assert dict(df.dtypes) == kinds
    assert rows(got) == rows(want)
    return len(got)
