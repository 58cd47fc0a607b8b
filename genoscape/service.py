"""HTTP front of stored models: GET /health, POST /predict {crop, trait, records}."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.study import FEATURES, WEATHER_BASIC
from .operators.training import Model, feature_values
from .plans.dialect import cut
from .sources.crops import read_dosage, read_weather


def weather_features(weather) -> dict:
    """Environment features of long weather rows."""
    spark = weather.sparkSession
    basic = WEATHER_BASIC.on(spark, long_series=weather)
    return feature_values(FEATURES.on(spark, weather_basic=basic))


class Models:
    """Model folders named {crop}__{trait} under a root, with the crop's inputs; both are read at the first request for them and kept."""

    def __init__(self, spark: SparkSession, root: str, data: str, id_map: str | None = None):
        self.spark, self.data, self.id_map = spark, data, id_map
        self.paths = {tuple(p.name.split("__", 1)): str(p) for p in sorted(Path(root).iterdir()) if "__" in p.name}
        self.models: dict[tuple[str, str], Model] = {}
        self.inputs: dict[str, tuple] = {}

    def model(self, crop: str, trait: str) -> Model:
        if (crop, trait) not in self.models:
            self.models[crop, trait] = Model(self.spark, self.paths[crop, trait])
        return self.models[crop, trait]

    def input(self, crop: str) -> tuple:
        if crop not in self.inputs:
            self.inputs[crop] = weather_features(read_weather(self.spark, self.data, crop, self.id_map)), cut(read_dosage(self.spark, self.data, crop))
        return self.inputs[crop]

    def predict(self, crop: str, trait: str, records: list[dict]) -> list[dict]:
        if (crop, trait) not in self.paths:
            raise LookupError(f"no model for {crop} {trait}")
        if not isinstance(records, list) or not records:
            raise ValueError("send at least one record, in a list")
        names = list(dict.fromkeys(k for r in records for k in r))
        if {"genotype_id", "environment_id"} - set(names):
            raise ValueError("records need genotype_id and environment_id")
        rows = self.spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records], ", ".join(f"`{n}` string" for n in names))
        values, dosage = self.input(crop)
        return [r.asDict() for r in self.model(crop, trait).predict(rows, dosage, values).collect()]


def answer(models: Models, method: str, path: str, body: bytes) -> tuple[int, dict]:
    if method == "GET" and path == "/health":
        return 200, {"status": "ok", "models": ["/".join(k) for k in models.paths]}
    if method != "POST" or path != "/predict":
        return 404, {"error": "not found"}
    try:
        asked = json.loads(body)
        return 200, {"predictions": models.predict(asked["crop"], asked["trait"], asked.get("records"))}
    except LookupError as e:
        return (404 if "no model" in str(e) else 400), {"error": str(e)}
    except (ValueError, TypeError) as e:
        return 400, {"error": str(e)}
    except Exception as e:  # the front stays up whatever a request does
        return 500, {"error": str(e)}


def serve(models: Models, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, doc = answer(models, self.command, self.path, body)
            out = json.dumps(doc).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _reply

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
