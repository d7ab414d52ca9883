"""The session's storage settings, for file systems opened inside tasks.

Spark reaches object stores with Hadoop's settings; the tasks that look at single files open them with
Arrow's file systems, which know nothing of those. Here the ones that say where a store is and who asks
are taken from the session, sent along with the work, and mapped to Arrow's arguments by scheme.
"""

from __future__ import annotations

from typing import Any
from urllib.parse import urlsplit

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

Settings = dict[str, str]

# Hadoop spells the S3 scheme in several ways.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss"}
_S3_KEYS = (
    "access.key secret.key session.token endpoint endpoint.region path.style.access "
    "connection.ssl.enabled assumed.role.arn assumed.role.session.name aws.credentials.provider"
).split()
_AZURE_KEYS = "account.key sas.fixed.token account.oauth2.client.id account.oauth2.client.secret account.oauth2.client.endpoint".split()


def _either(keys: list[str]) -> str:
    return "|".join(key.replace(".", r"\.") for key in keys)


# What is taken from the session: nothing else leaves the driver.
WANTED = rf"^fs\.(s3a\.(bucket\.[^/]+\.)?({_either(_S3_KEYS)})|azure\.({_either(_AZURE_KEYS)})(\..+)?|gs\.project\.id)$"

# Those of the task that this process works for; set by ``use`` ahead of its files.
_used: Settings = {}


def session_settings(spark: SparkSession) -> Settings:
    """Settings of the session's Hadoop configuration that the file systems of tasks need."""
    found = spark._jsc.hadoopConfiguration().getValByRegex(WANTED)
    return {str(key): str(found[key]) for key in found}


def use(settings: Settings) -> None:
    """Have ``resolve`` open file systems with these settings, in this process."""
    _used.clear()
    _used.update(settings)


def _s3(settings: Settings, bucket: str) -> dict[str, Any]:
    def get(key: str) -> str | None:
        return settings.get(f"fs.s3a.bucket.{bucket}.{key}") or settings.get(f"fs.s3a.{key}") or None

    found: dict[str, Any] = {
        "access_key": get("access.key"),
        "secret_key": get("secret.key"),
        "session_token": get("session.token"),
        "region": get("endpoint.region"),
        "role_arn": get("assumed.role.arn"),
        "session_name": get("assumed.role.session.name"),
    }
    endpoint = get("endpoint")
    if endpoint:
        scheme, _, host = endpoint.rpartition("://")
        found["endpoint_override"] = host
        # With an endpoint of its own Arrow addresses buckets by path unless told otherwise.
        found["force_virtual_addressing"] = (get("path.style.access") or "false") != "true"
        if scheme:
            found["scheme"] = scheme
    if get("connection.ssl.enabled") == "false":
        found["scheme"] = "http"
    if "Anonymous" in (get("aws.credentials.provider") or "") and not found["access_key"]:
        found["anonymous"] = True
    return {key: value for key, value in found.items() if value is not None}


def _azure(settings: Settings, authority: str) -> dict[str, Any]:
    host = authority.rpartition("@")[2]

    def get(key: str) -> str | None:
        return settings.get(f"fs.azure.{key}.{host}") or settings.get(f"fs.azure.{key}") or None

    # The address of the identity service ends in the tenant: https://host/TENANT/oauth2/token.
    address = [part for part in urlsplit(get("account.oauth2.client.endpoint") or "").path.split("/") if part]
    found = {
        "account_name": host.partition(".")[0],
        "account_key": get("account.key"),
        "sas_token": get("sas.fixed.token"),
        "client_id": get("account.oauth2.client.id"),
        "client_secret": get("account.oauth2.client.secret"),
        "tenant_id": address[0] if address else None,
    }
    return {key: value for key, value in found.items() if value is not None}


def options_for(settings: Settings, scheme: str, authority: str) -> tuple[str, dict[str, Any]] | None:
    """Name of Arrow's file system for a scheme and its arguments; None if the settings say nothing."""
    scheme = _SCHEMES.get(scheme, scheme)
    if scheme == "s3":
        found = _s3(settings, authority)
        return ("S3FileSystem", found) if found else None
    if scheme == "abfss":
        found = _azure(settings, authority)
        return ("AzureFileSystem", found) if len(found) > 1 else None
    if scheme == "gs" and "fs.gs.project.id" in settings:
        return "GcsFileSystem", {"project_id": settings["fs.gs.project.id"]}
    return None


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a Hadoop-style path, and the path inside it, taken literally."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority = rest.removeprefix("//").partition("/")[0]
    inside = path[len(f"{scheme}://{authority}") :].lstrip("/")
    chosen = options_for(_used, scheme, authority)
    if chosen is not None:
        name, arguments = chosen
        root = authority.partition("@")[0]  # the container, of a store that names its account too
        return getattr(pafs, name)(**arguments), f"{root}/{inside}" if inside else root
    fs, root = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")
    return fs, f"{root.rstrip('/')}/{inside}" if root.strip("/") else inside
