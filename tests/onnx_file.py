"""A tiny ONNX text model, written field by field: no package to build one is at hand.

Its inputs are declared in another order than ours, so that only binding by name
gives the right result. The state of a position is ``x, -x`` with
``x = input_ids * attention_mask - token_type_ids``.
"""


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(field, value):
    return varint(field << 3) + varint(value)


def block(field, content):
    content = content.encode() if isinstance(content, str) else content
    return varint(field << 3 | 2) + varint(len(content)) + content


def node(kind, inputs, output, *attributes):
    return block(
        1, b"".join(block(1, i) for i in inputs) + block(2, output) + block(4, kind) + b"".join(block(5, a) for a in attributes)
    )


def attribute(name, value):
    if isinstance(value, list):
        return block(1, name) + b"".join(number(8, v) for v in value) + number(20, 7)
    return block(1, name) + number(3, value) + number(20, 2)


def tensor(field, name, kind, *dimensions):
    shape = b"".join(block(1, block(2, d) if isinstance(d, str) else number(1, d)) for d in dimensions)
    return block(field, block(1, name) + block(2, block(1, number(1, kind) + block(2, shape))))


def model():
    graph = (
        node("Mul", ["input_ids", "attention_mask"], "kept")
        + node("Sub", ["kept", "token_type_ids"], "typed")
        + node("Cast", ["typed"], "real", attribute("to", 1))
        + node("Unsqueeze", ["real"], "plus", attribute("axes", [2]))
        + node("Neg", ["plus"], "minus")
        + node("Concat", ["plus", "minus"], "last_hidden_state", attribute("axis", 2))
        + block(2, "tiny")
        + b"".join(tensor(11, name, 7, "b", "s") for name in ("attention_mask", "token_type_ids", "input_ids"))
        + tensor(12, "last_hidden_state", 1, "b", "s", 2)
    )
    return number(1, 6) + block(7, graph) + block(8, number(2, 11))
