"""Hashes, encryption and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

md5, sha1, crc32 = F.md5, F.sha1, F.crc32
xxhash64, hash_ = F.xxhash64, F.hash
url_encode, url_decode = F.url_encode, F.url_decode
base64_encode, hex_, unhex = F.base64, F.hex, F.unhex


def sha2(c, bits: int) -> Column:
    return F.sha2(column(c), bits)


def aes_encrypt(c, key) -> Column:
    return F.aes_encrypt(column(c), const(key))


def aes_decrypt(c, key) -> Column:
    return F.aes_decrypt(column(c), const(key)).cast("string")


def try_aes_decrypt(c, key) -> Column:
    return F.try_aes_decrypt(column(c), const(key)).cast("string")


def base64_decode(c) -> Column:
    return F.unbase64(column(c)).cast("string")
