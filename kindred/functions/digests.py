"""Digests and identifiers made of them."""

from pyspark.sql import Column, functions as F

#: Bytes that partial digests skip and read, and the size below which they are the whole digest.
PARTIAL_OFFSET = PARTIAL_SIZE = 16 * 1024
#: Bytes of each of the three samples, and the size up to which they are the whole digest.
SAMPLE, SAMPLED_FROM = 1024 * 1024, 3 * 1024 * 1024
#: The kind of group that a dataset's units are.
UNIT = "dataset-cluster"


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def content_digest(content: Column) -> Column:
    """Of the whole content."""
    return F.sha2(content.cast("binary"), 256)


def partial_digest(content: Column) -> Column:
    """Of 16 KiB behind the first 16 KiB; of smaller content than both, the whole digest."""
    data = content.cast("binary")
    return F.when(F.octet_length(data) < PARTIAL_OFFSET + PARTIAL_SIZE, F.sha2(data, 256)).otherwise(F.sha2(F.substring(data, PARTIAL_OFFSET + 1, PARTIAL_SIZE), 256))


def sample_digest(content: Column) -> Column:
    """Of samples at a quarter, at three fifths and at the end; of smaller content, the whole digest."""
    data, n = content.cast("binary"), F.octet_length(content.cast("binary"))
    at = lambda x: F.substring(data, (x + 1).cast("int"), F.lit(SAMPLE))
    three = F.concat(at(F.floor(n * 25 / 100)), at(F.floor(n * 60 / 100)), at(n - SAMPLE))
    return F.when(n <= SAMPLED_FROM, F.sha2(data, 256)).otherwise(F.sha2(three, 256))


def split_of(cluster: Column, seed: str, weights: dict[str, float]) -> Column:
    """A split by the first 8 bytes of SHA-256(seed NUL cluster), as a fraction of 2**64 along the cumulated weights of splits by name."""
    raw = F.substring(_sha(F.lit(seed), cluster), 1, 16)
    part = F.conv(raw, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
    total, upto, out = sum(weights.values()), 0.0, None
    names = sorted(weights)
    for name in names[:-1]:
        upto += weights[name] / total
        out = F.when(part < upto, name) if out is None else out.when(part < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def group_id(kind: str, members: Column, discriminator: str = "") -> Column:
    """Kind and SHA-256 of kind, discriminator and the sorted distinct members."""
    m = F.array_sort(F.array_distinct(members))
    return F.concat(F.lit(kind + ":"), F.sha2(F.concat_ws("\0", F.lit(kind), F.lit(discriminator), m).cast("binary"), 256))


def unit_id(members: Column) -> Column:
    """Of one member an id of its own, of more a group id."""
    return F.when(F.size(members) == 1, _sha(F.lit(UNIT), members[0])).otherwise(group_id(UNIT, members))


def action_id(group: Column, target: Column, operation: Column) -> Column:
    """C36."""
    return _sha(group, target, operation)


def _prefixed(value: Column) -> Column:
    data = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data)


def length_prefixed_digest(*values: Column) -> Column:
    """SHA-256 over each value's 8-byte big-endian length and bytes."""
    return F.sha2(F.concat(*map(_prefixed, values)), 256)


def member_digest(path: Column, *ids: Column) -> Column:
    """Of a group's member; a missing id counts as "-"."""
    return length_prefixed_digest(path, *[F.coalesce(i.cast("string"), F.lit("-")) for i in ids])


def catalog_group_id(scan: Column, size: Column, digest: Column, members: Column) -> Column:
    """Over the sorted member digests."""
    body = F.array_join(F.transform(F.array_sort(members), lambda m: F.hex(_prefixed(m))), "")
    head = F.concat(*[F.hex(_prefixed(v.cast("string"))) for v in (F.lit("catalog-group-v1"), scan, size, digest)])
    return F.sha2(F.unhex(F.concat(head, body)), 256)


def path_key(path: Column, fold: bool = False) -> Column:
    """C41 for clean ASCII paths: doubled slashes, "." parts and the last slash vanish; ``fold`` also folds case."""
    p = F.regexp_replace(path, r"/(?:\.(?=/|$)|/)+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"(?<=.)/$", "")
    return F.lower(p) if fold else p


def parent_key(key: Column) -> Column:
    return F.regexp_replace(key, r"(?s)/[^/]*$", "")
