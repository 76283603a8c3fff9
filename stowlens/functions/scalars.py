"""Column functions over sizes, dates, names, file IDs and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes by unit letter (fixed values).
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}
RECORD, FIELD = "\x01", "\x02"
#: Base64 letters of file IDs and where they differ from the usual ones.
ID_FROM, ID_TO = "-_.", "+/="


def chain(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """when().when()...otherwise(), first match wins."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double, `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b.cast("double"))


def parse_size(text: Column) -> Column:
    """Bytes of '10', '1.5K', '2 GB'; null for anything else. Fractions of a byte are cut off."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 2))
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[unit]
    return F.when(number != "", F.floor(number.try_cast("double") * factor).cast("long"))


def format_bytes(size: Column) -> Column:
    """'512 B', '1.50 KB': two decimals from 1 KB on, ties to the even one as printf has them."""
    def shown(unit: str) -> Column:
        return F.format_string("%.2f " + unit, F.bround(size / F.lit(float(UNITS[unit])), 2))

    return chain((size >= UNITS["TB"], shown("TB")), (size >= UNITS["GB"], shown("GB")), (size >= UNITS["MB"], shown("MB")), (size >= UNITS["KB"], shown("KB")), otherwise=F.format_string("%d B", size))


def parse_date(text: Column) -> Column:
    """Epoch seconds from digits or from a Y-M-D date."""
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("long")), F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def format_timestamp(epoch: Column, empty: str = "Unknown") -> Column:
    return F.when(epoch == 0, F.lit(empty)).otherwise(F.from_unixtime(epoch, "yyyy-MM-dd HH:mm:ss"))


def extension_of_name(file_id: Column) -> Column:
    """Lower-cased extension of the base name, 'no_ext' without one."""
    found = F.lower(F.regexp_extract(file_id, r"\.([^./]+)$", 1))
    return F.when(found == "", "no_ext").otherwise(found)


def extension_of_id(file_id: Column) -> Column:
    """All after the last dot of the whole ID, its case kept; 'no_ext' without a dot."""
    return F.when(file_id.contains("."), F.substring_index(file_id, ".", -1)).otherwise("no_ext")


def extension_short(name: Column) -> Column:
    """After the last dot, six characters at most; '' without one."""
    return F.when(name.contains("."), F.substring(F.substring_index(name, ".", -1), 1, 6)).otherwise("")


def extension_near_end(name: Column) -> Column:
    """After a dot among the last six characters, null without one."""
    found = F.regexp_extract(name, r"\.([^.]{0,5})$", 1)
    return F.when(name.rlike(r"\.[^.]{0,5}$"), found)


def group_of(file_id: Column) -> Column:
    return F.when(file_id.contains("/"), F.substring_index(file_id, "/", 1))


def split_id(file_id: Column) -> Column:
    """(group_name, path) of a valid ID: a group of 1 to 16 characters, then a path; else null."""
    valid = file_id.rlike(r"^[^/]{1,16}/.+$")
    return F.when(valid, F.struct(F.substring_index(file_id, "/", 1).alias("group_name"), F.regexp_replace(file_id, "^[^/]*/", "").alias("path")))


def _u32(binary: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(binary, at, 4)), 16, 10).cast("long")


def decode_id(file_id: Column) -> Column:
    """What a file ID says of its file: source, creation, size (null where unknown) and crc32.

    The name's first 27 characters are 20 bytes in base64: source, time, masked size and crc32. The
    size's flags tell the kind; an appender's or slave's size isn't in the ID.
    """
    name = F.substring_index(file_id, "/", -1)
    raw = F.unbase64(F.concat(F.translate(F.substring(name, 1, 27), ID_FROM, ID_TO), F.lit("=")))
    high, low = _u32(raw, 9), _u32(raw, 13)
    trunk = high.bitwiseAND(F.lit(1 << 27)) != 0
    appender = high.bitwiseAND(F.lit(1 << 26)) != 0
    slave = F.length(F.regexp_extract(name, r"^([^.]*)", 1)) > F.when(trunk, 43).otherwise(27)
    size = chain((appender | slave, F.lit(None).cast("long")), ((high.bitwiseAND(F.lit(1 << 31)) != 0) | trunk, low), otherwise=F.shiftleft(high, 32) + low)
    kind = chain((appender, "appender"), (slave, "slave"), (trunk, "trunk"), otherwise="normal")
    valid = F.length(name) >= 27
    return F.when(valid, F.struct(_u32(raw, 1).alias("source"), _u32(raw, 5).alias("create_ts"), size.alias("size"), _u32(raw, 17).alias("crc32"), kind.alias("kind")))


def _be(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def encode_id(group: Column, path: Column, source: Column, create_ts: Column, size: Column, crc32: Column, ext: Column) -> Column:
    """A file ID from its parts; sizes below 4 GiB carry the flag of a 32-bit size and no random bits."""
    masked = F.when(size < F.lit(1 << 32), F.concat(F.lit("80000000"), _be(size, 8))).otherwise(_be(size, 16))
    raw = F.unhex(F.concat(_be(source, 8), _be(create_ts, 8), masked, _be(crc32, 8)))
    return F.concat(group, F.lit("/"), path, F.lit("/"), F.translate(F.regexp_replace(F.base64(raw), "=+$", ""), ID_TO[:2], ID_FROM[:2]), ext)


def encode_trunk(trunk_id: Column, offset: Column, size: Column) -> Column:
    """12 bytes of trunk id, offset and size as 16 characters."""
    return F.translate(F.base64(F.unhex(F.concat(_be(trunk_id, 8), _be(offset, 8), _be(size, 8)))), "+/", "-_")


def decode_trunk(text: Column) -> Column:
    raw = F.unbase64(F.translate(text, "-_", "+/"))
    return F.struct(_u32(raw, 1).alias("trunk_id"), _u32(raw, 5).alias("offset"), _u32(raw, 9).alias("size"))


def glob(name: Column, pattern: str) -> Column:
    """fnmatch with *, ?, [abc] and [!abc], anchored at both ends."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return name.rlike("(?s)^" + out + "$")


def base_name(file_id: Column) -> Column:
    return F.substring_index(file_id, "/", -1)


def split_tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def key_value(text: Column) -> Column:
    """(key, value) of 'key=value' with quotes around the value taken off; null without '=' or key."""
    key = F.trim(F.regexp_extract(text, r"^([^=]*)=", 1))
    value = F.regexp_replace(F.trim(F.regexp_extract(text, r"^[^=]*=(.*)$", 1)), "^([\"'])(.*)\\1$", "$2")
    return F.when(key != "", F.struct(key.alias("key"), value.alias("value")))


def pack_metadata(entries: Column) -> Column:
    """A map as text: records and fields with their separators, by name."""
    pairs = F.array_sort(F.map_entries(entries))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(FIELD), e["value"])), RECORD)


def unpack_metadata(text: Column) -> Column:
    """The map of packed metadata; the last of equal names wins."""
    pairs = F.filter(F.transform(F.split(text, RECORD), lambda r: F.split(r, FIELD)), lambda p: F.size(p) == 2)
    last = F.filter(pairs, lambda p: p[0] != "")
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(last, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p[0]), F.create_map(p[0], p[1])))


def format_duration(seconds: Column) -> Column:
    """'59s', '3m 5s', '2h 3m', '1d 4h'."""
    return chain(
        (seconds < 60, F.format_string("%ds", seconds)),
        (seconds < 3600, F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60)),
        (seconds < 86400, F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60))),
        otherwise=F.format_string("%dd %dh", F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600)),
    )


def percent_change(baseline: Column, current: Column) -> Column:
    return ratio((current - baseline) * 100, baseline)


def export_path(folder: str, file_id: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.translate(file_id, "/", "_"))


def access_token(file_id: Column, secret: str, epoch: Column) -> Column:
    return F.md5(F.concat(file_id, F.lit(secret), epoch.cast("string")).cast("binary"))


def token_valid(file_id: Column, secret: str, epoch: Column, token: Column, now: Column, ttl: int) -> Column:
    """32 characters, not expired (an epoch of 0 never expires), and the right ones."""
    alive = (epoch == 0) | (now - epoch <= ttl)
    return (F.length(token) == 32) & alive & (token == access_token(file_id, secret, epoch))


def first_parameter(query: Column, name: str) -> Column:
    """The first value of a name in 'a=1&b=2'."""
    hits = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == name)
    return F.when(F.size(hits) > 0, F.regexp_replace(hits[0], "^[^=]*=?", ""))


def slave_name(master: Column, prefix: Column, ext: Column) -> Column:
    """A slave file's name: the master's without extension, the prefix, and an extension.

    A null ext takes the master's; one without a dot gets it. Null where the master is shorter than 28
    characters, where the prefix is '-m' without extension, or where it is empty and the extensions agree.
    """
    master_ext = F.regexp_extract(master, r"(\.[^./]{0,6})$", 1)
    stem = F.regexp_replace(master, r"\.[^./]{0,6}$", "")
    wanted = chain((ext.isNull(), master_ext), ((ext == "") | ext.startswith("."), ext), otherwise=F.concat(F.lit("."), ext))
    invalid = (F.length(master) < 28) | ((prefix == "-m") & (wanted == "")) | ((prefix == "") & (wanted == master_ext))
    return F.when(~invalid, F.concat(stem, prefix, wanted))


def bandwidth_mbps(size: Column, seconds: Column) -> Column:
    return ratio(size * 8, seconds * 1e6)


def path_hash(name: Column) -> Column:
    """The two directory levels of a name: the PJW hash of its characters modulo 65536, high and low byte."""
    def step(h: Column, c: Column) -> Column:
        h = (F.shiftleft(h, 4) + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF))
        top = h.bitwiseAND(F.lit(0xF0000000))
        return F.when(top != 0, h.bitwiseXOR(F.shiftright(top, 24)).bitwiseAND(F.lit(0x0FFFFFFF))).otherwise(h)

    letters = F.filter(F.split(name, ""), lambda c: c != "")
    h = F.aggregate(letters, F.lit(0).cast("long"), step) % 65536
    return F.struct(F.shiftright(h, 8).cast("int").alias("high"), h.bitwiseAND(F.lit(0xFF)).cast("int").alias("low"))
