"""Sources encrypted at rest with AES-256-GCM.

Spark's own functions are used: a fresh 12-byte nonce in front, a 16-byte tag behind.  The
key comes from the caller, never from a column.
"""

import base64

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.functions.text import stored_line_count

KEY_BYTES = 32
OVERHEAD_BYTES = 28


def check_key(key: bytes) -> bytes:
    if not isinstance(key, (bytes, bytearray)) or len(key) != KEY_BYTES:
        raise ValueError(f"the key must have exactly {KEY_BYTES} bytes")
    return bytes(key)


def key_to_base64(key: bytes) -> str:
    return base64.b64encode(check_key(key)).decode("ascii")


def key_from_base64(text: str) -> bytes:
    return check_key(base64.b64decode(text, validate=True))


def encrypt(col: Column, key: bytes) -> Column:
    return F.aes_encrypt(col, F.lit(check_key(key)), F.lit("GCM"))


def decrypt(blob: Column, key: bytes) -> Column:
    """The text, or NULL when the blob is short, altered or of another key."""
    return F.try_aes_decrypt(blob, F.lit(check_key(key)), F.lit("GCM")).cast("string")


def store(files: DataFrame, key: bytes) -> DataFrame:
    """Replace ``source`` by ``encrypted_source``, with the size and line count of the text."""
    return files.withColumn("line_count", stored_line_count(F.col("source"))) \
        .withColumn("size_bytes", F.octet_length("source")) \
        .withColumn("encrypted_source", encrypt(F.col("source"), key)).drop("source")


def load(stored: DataFrame, key: bytes) -> DataFrame:
    """Texts back from the store; files that do not open are marked failed, not dropped."""
    out = stored.withColumn("source", decrypt(F.col("encrypted_source"), key)).drop("encrypted_source")
    broken = F.col("source").isNull()
    return out.withColumn("status", F.when(broken, "failed").otherwise("pending")) \
        .withColumn("error_message", F.when(broken, "Could not decrypt source").otherwise(""))
