"""SHA-256 that can stop in one task and go on in another.

``hashlib`` keeps the state of a digest to itself.  Here it is the context of the
OpenSSL library that ``hashlib`` itself is linked to, as bytes: a file too large for
one task is hashed piece by piece, each piece with the state that the one before left.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from functools import cache


class _Context(ctypes.Structure):
    """SHA256_CTX of openssl/sha.h."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8),
        ("bits_low", ctypes.c_uint32),
        ("bits_high", ctypes.c_uint32),
        ("block", ctypes.c_uint32 * 16),
        ("held", ctypes.c_uint),
        ("digest_bytes", ctypes.c_uint),
    ]


def _load(name: str) -> ctypes.CDLL:
    library = ctypes.CDLL(name)
    context = ctypes.POINTER(_Context)
    library.SHA256_Init.argtypes = [context]
    library.SHA256_Update.argtypes = [context, ctypes.c_char_p, ctypes.c_size_t]
    library.SHA256_Final.argtypes = [ctypes.c_char_p, context]
    return library


@cache
def _library() -> ctypes.CDLL:
    import _hashlib

    names = [getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")]
    for name in filter(None, names):
        try:
            return _load(name)
        except (OSError, AttributeError):
            continue
    raise OSError("no OpenSSL library with SHA256_Init, SHA256_Update and SHA256_Final")


def start() -> bytes:
    context = _Context()
    _library().SHA256_Init(context)
    return bytes(context)


def extend(state: bytes, data: bytes) -> bytes:
    context = _Context.from_buffer_copy(state)
    _library().SHA256_Update(context, data, len(data))
    return bytes(context)


def finish(state: bytes) -> str:
    """The digest as lower-case hex."""
    context = _Context.from_buffer_copy(state)
    digest = ctypes.create_string_buffer(32)
    _library().SHA256_Final(digest, context)
    return digest.raw.hex()


@cache
def available() -> bool:
    """Is there a library, and does it give what ``hashlib`` gives?"""
    sample = bytes(range(256)) * 3
    try:
        return finish(extend(extend(start(), sample[:77]), sample[77:])) == hashlib.sha256(sample).hexdigest()
    except OSError:
        return False
