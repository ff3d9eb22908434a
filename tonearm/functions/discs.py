"""Disc times and identifiers: 1/75 s frames, tables of contents, published id algorithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES_PER_SECOND = 75
LEAD_IN = 150
#: Frames between the audio's lead-out and the data track of an enhanced disc.
DATA_GAP = 11400


def parse_msf(text: Column) -> Column:
    """mm:ss:ff as frames; null unless 0 <= ss < 60 and 0 <= ff < 75."""
    parts = F.transform(F.split(text, ":"), lambda x: F.trim(x).try_cast("int"))

    def frames(p: Column) -> Column:
        m, s, f = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
        ok = (F.size(p) == 3) & (m >= 0) & (s >= 0) & (s < 60) & (f >= 0) & (f < FRAMES_PER_SECOND)
        return F.when(ok, (m * 60 + s) * FRAMES_PER_SECOND + f)

    return F.get(F.transform(F.array(parts), frames), 0)  # in an array of one, the parts are cut once and not for each use


def format_msf(frames: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(frames / 4500), F.floor(frames / 75) % 60, frames % 75)


def frames_to_samples(frames: Column, rate: Column) -> Column:
    """Whole samples of so many frames."""
    return F.floor(frames * rate / FRAMES_PER_SECOND).cast("long")


def lead_out(total: Column, data_track: Column) -> Column:
    """Absolute frame of the lead-out: before the data track's gap, or after the audio."""
    return F.when(data_track.isNotNull(), data_track - DATA_GAP).otherwise(total + LEAD_IN)


def musicbrainz_id(first: Column, last: Column, lead: Column, offsets: Column) -> Column:
    """SHA-1 of the hexadecimal table of contents (99 offsets, zeros for missing), in base64 with ``._-``."""
    hexed = lambda n, width: F.lpad(F.hex(n.cast("long")), width, "0")
    slots = F.array_join(F.transform(F.slice(offsets, 1, 99), lambda o: hexed(F.coalesce(o, F.lit(0)), 8)), "")  # only the offsets there are; the rest is zeros
    return F.translate(F.base64(F.unhex(F.sha1(F.concat(hexed(first, 2), hexed(last, 2), hexed(lead, 8), F.rpad(F.coalesce(slots, F.lit("")), 8 * 99, "0"))))), "+/=", "._-")


def _digit_sum(n: Column) -> Column:
    return F.aggregate(F.split(n.cast("string"), ""), F.lit(0).cast("long"), lambda s, d: s + F.coalesce(d.try_cast("long"), F.lit(0)))


def freedb_id(lead: Column, offsets: Column) -> Column:
    """Checksum of the start seconds, the playing time and the number of tracks, as 8 hexadecimal digits."""
    seconds = F.transform(offsets, lambda o: F.floor(o / FRAMES_PER_SECOND))
    check = F.aggregate(seconds, F.lit(0).cast("long"), lambda s, x: s + _digit_sum(x)) % 255
    length = F.floor(lead / FRAMES_PER_SECOND) - seconds[0]
    return F.lpad(F.hex(F.shiftleft(check, 24).bitwiseOR(F.shiftleft(length, 8)).bitwiseOR(F.size(offsets).cast("long"))), 8, "0")


def ctdb_toc(lead: Column, offsets: Column) -> Column:
    """Offsets and lead-out without the lead-in, joined by colons."""
    return F.concat_ws(":", F.array_join(F.transform(offsets, lambda o: (o - LEAD_IN).cast("string")), ":"), (lead - LEAD_IN).cast("string"))


def musicbrainz_toc(first: Column, last: Column, lead: Column, offsets: Column) -> Column:
    return F.concat_ws("+", first.cast("string"), last.cast("string"), lead.cast("string"), F.array_join(F.transform(offsets, lambda o: o.cast("string")), "+"))

#: Samples that a disc checksum leaves out at both ends of a disc, and bytes of a 16-bit stereo sample.
TRIM_SAMPLES, SAMPLE_BYTES = 5880, 4


def track_crc(pcm: Column, is_first: Column, is_last: Column) -> Column:
    """CRC-32 of a track's PCM without the trim at the disc's start or end; null if nothing is left."""
    trim = TRIM_SAMPLES * SAMPLE_BYTES
    head, tail = F.when(is_first, trim).otherwise(0), F.when(is_last, trim).otherwise(0)
    left = F.octet_length(pcm) - head - tail
    return F.when(left > 0, F.crc32(F.substring(pcm, head + 1, left)))


def folder_of(base: Column, disc: Column, total: Column) -> Column:
    """The folder of a set member's files: ``base/Disc n`` where the set has several discs."""
    return F.when(total > 1, F.concat(base, F.lit("/Disc "), disc.cast("string"))).otherwise(base)
