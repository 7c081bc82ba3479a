"""Contents of any depth against the recursion they are defined by."""

import json
import random

from presswire.operators import contents


def text(content):
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        for key in ("text", "output"):
            if content.get(key):
                return content[key]
        return text(content["content"]) if "content" in content else json.dumps(content, separators=(",", ":"), sort_keys=True)
    parts = []
    for item in content:
        if isinstance(item, str):
            parts.append(item)
        elif item.get("type") in contents.TEXT_TYPES:
            parts += [item["text"]] if item.get("text") else []
        elif "content" in item:
            parts += [t] if (t := text(item["content"])) else []
        elif item.get("output"):
            parts.append(item["output"])
    return "\n".join(parts)


def some(rng, depth):
    word = rng.choice(["a", "b c", "", "d\ne", 'q"x'])
    if depth == 0:
        return word
    kind = rng.randrange(6)
    if kind == 0:
        return word
    if kind == 1:
        return {"content": some(rng, depth - 1)}
    if kind == 2:
        return {rng.choice(["text", "output"]): word, "content": some(rng, depth - 1)}
    items = [word, {"type": "text", "text": word}, {"type": "image"}, {"output": word}, {"content": some(rng, depth - 1)}, {"type": "tool", "content": some(rng, depth - 1)}, {"content": [""]}]
    return rng.sample(items, rng.randrange(len(items)))


def test_equals_recursion(spark):
    rng = random.Random(8)
    deep = "bottom"
    for i in range(12):
        deep = [{"type": "text", "text": f"level {i}"}, {"content": deep}] if i % 2 else {"content": deep}
    rows = [some(rng, rng.randrange(13)) for _ in range(250)] + [deep, None, [], {"b": "x", "a": "y"}, [[]][0], {"content": None}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9999, None), (9998, "not json")], "i int, content string")
    got = {r["i"]: r["text"] for r in contents.texts(df, "i", "content").collect()}
    assert got.pop(9999) == "" and got.pop(9998) == ""
    assert got == {i: text(r) for i, r in enumerate(rows)}
    assert got[250].startswith("level 11\nlevel 9") and got[250].endswith("bottom")
