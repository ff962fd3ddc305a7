"""Adapters for recognition, speech, embedding and language models that may be installed.

Each is registered under its usual name; its factory imports the library on the worker, once, and
gives a null engine where that is missing, so plans run everywhere and tell by their results.
"""

from __future__ import annotations

import io
import math
import os
from typing import Any

import numpy as np

from folioforge.operators.ocr import PADDLE_LANGUAGES, TESSERACT_LANGUAGES
from folioforge.operators.reasoning import ANSWER_CONFIDENCE, SYSTEM_PROMPT, UNCERTAIN_CONFIDENCE
from folioforge.plans import engines
from folioforge.sources.media import RATE


def _image(data: bytes) -> Any:
    from PIL import Image

    return Image.open(io.BytesIO(data)).convert("RGB")


def _word(text: str, confidence: float, x0: float, y0: float, x1: float, y1: float) -> dict:
    return {"text": text, "confidence": float(confidence), "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def paddle(language: str = "en") -> engines.Engine:
    from paddleocr import PaddleOCR

    model = PaddleOCR(use_angle_cls=True, lang=PADDLE_LANGUAGES.get(language, "en"), show_log=False)

    def words(data: bytes) -> list[dict]:
        lines = (model.ocr(np.asarray(_image(data)), cls=True) or [None])[0] or []
        return [_word(t, c * 100, min(p[0] for p in box), min(p[1] for p in box), max(p[0] for p in box), max(p[1] for p in box)) for box, (t, c) in lines if t.strip()]

    return lambda values: [words(v) for v in values]


def tesseract(language: str = "en", config: str = "--psm 6 --oem 3") -> engines.Engine:
    import pytesseract

    tags = "+".join(TESSERACT_LANGUAGES.get(part.strip(), "eng") for part in language.split("+"))

    def words(data: bytes) -> list[dict]:
        d = pytesseract.image_to_data(_image(data), lang=tags, config=config, output_type=pytesseract.Output.DICT)
        rows = zip(d["text"], map(float, d["conf"]), d["left"], d["top"], d["width"], d["height"], strict=True)
        return [_word(t, c, x, y, x + w, y + h) for t, c, x, y, w, h in rows if c >= 0 and t.strip()]

    return lambda values: [words(v) for v in values]


def tesseract_devanagari(language: str = "hi") -> engines.Engine:
    recognise = tesseract(language, "--oem 1 --psm 6")

    def region(words: list[dict]) -> dict:
        good = [w["confidence"] for w in words]
        return {"text": " ".join(w["text"] for w in words), "confidence": round(sum(good) / len(good), 2) if good else 0.0, "language": language}

    return lambda values: [region(w) for w in recognise(values)]


def trocr(name: str = "microsoft/trocr-base-handwritten") -> engines.Engine:
    import torch
    from transformers import TrOCRProcessor, VisionEncoderDecoderModel

    processor, model = TrOCRProcessor.from_pretrained(name), VisionEncoderDecoderModel.from_pretrained(name)

    def region(data: bytes) -> dict:
        with torch.no_grad():
            out = model.generate(processor(images=_image(data), return_tensors="pt").pixel_values, num_beams=4, max_new_tokens=128, output_scores=True, return_dict_in_generate=True)
        best = [float(s.softmax(-1).max()) for s in out.scores]
        logs = [math.log(p) for p in best if p > 0]
        confidence = round(min(100.0, 100 * math.exp(sum(logs) / len(logs))), 2) if logs else 0.0
        return {"text": processor.batch_decode(out.sequences, skip_special_tokens=True)[0].strip(), "confidence": confidence, "language": "en"}

    return lambda values: [region(v) for v in values]


def _segment(number: int, start: float, end: float, text: str, logprob: float, silence: float, language: str) -> dict:
    return {"segment_id": number, "start_s": float(start), "end_s": float(end), "text": text, "avg_logprob": float(logprob), "no_speech_prob": float(silence), "language": language}


def whisper(size: str = "base") -> engines.Engine:
    import whisper as library

    model = library.load_model(size)

    def segments(samples: list[float]) -> list[dict]:
        got = model.transcribe(np.asarray(samples, np.float32), compression_ratio_threshold=2.4, logprob_threshold=-1.0, no_speech_threshold=0.6)
        return [_segment(i, s["start"], s["end"], s["text"], s.get("avg_logprob", -0.5), s.get("no_speech_prob", 0.0), got.get("language", "en")) for i, s in enumerate(got["segments"])]

    return lambda values: [segments(v) for v in values]


def faster_whisper(size: str = "base") -> engines.Engine:
    from faster_whisper import WhisperModel

    model = WhisperModel(size, compute_type="int8")

    def segments(samples: list[float]) -> list[dict]:
        found, info = model.transcribe(np.asarray(samples, np.float32), beam_size=5, vad_filter=True)
        return [_segment(i, s.start, s.end, s.text, s.avg_logprob, s.no_speech_prob, info.language) for i, s in enumerate(found)]

    return lambda values: [segments(v) for v in values]


def sentence_transformer(name: str = "sentence-transformers/all-MiniLM-L6-v2") -> engines.Engine:
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(name)
    return lambda values: [v.tolist() for v in model.encode(values, normalize_embeddings=True)]


def _hosted() -> Any:
    import google.generativeai as library

    library.configure(api_key=os.environ["GEMINI_API_KEY"])
    return library


def gemini_embedding(name: str = "models/text-embedding-004") -> engines.Engine:
    library = _hosted()
    return lambda values: [library.embed_content(model=name, content=v)["embedding"] for v in values]


def gemini(name: str = "gemini-1.5-flash") -> engines.Engine:
    model = _hosted().GenerativeModel(name, system_instruction=SYSTEM_PROMPT)

    def answer(prompt: str) -> dict:
        told = model.generate_content(prompt, generation_config={"temperature": 0.2, "top_p": 0.8}).text
        return {"text": told, "confidence": UNCERTAIN_CONFIDENCE if "[UNCERTAIN]" in told else ANSWER_CONFIDENCE, "engine_name": "gemini", "tokens_used": len(told.split())}

    return lambda values: [answer(v) for v in values]


def pymupdf(dpi: int = 300) -> engines.Engine:
    import fitz

    def pages(data: bytes) -> list[dict]:
        with fitz.open(stream=data, filetype="pdf") as document:
            return [{"page": i + 1, "native_text": p.get_text(), "raster": p.get_pixmap(dpi=dpi).tobytes("png")} for i, p in enumerate(document)]

    return lambda values: [pages(v) for v in values]


def langdetect() -> engines.Engine:
    """Language of texts of 20 characters or more, by their first 2000; `en` for others and on failure."""
    import langdetect as library

    def language(text: str | None) -> str:
        try:
            return library.detect(text[:2000]) if text and len(text) >= 20 else "en"
        except library.LangDetectException:
            return "en"

    return lambda values: [language(v) for v in values]


def pydub(rate: int = RATE) -> Any:
    """A decoder for `media.load_audio` of whatever the installed converter reads."""

    def decode(content: bytes) -> tuple[np.ndarray, int]:
        from pydub import AudioSegment

        sound = AudioSegment.from_file(io.BytesIO(content)).set_channels(1).set_frame_rate(rate).set_sample_width(2)
        return np.array(sound.get_array_of_samples(), np.float32) / 32768.0, rate

    return decode


# What the models' classes mean.
LAYOUT_TYPES = {"Text": "body", "Title": "heading", "List": "body", "Table": "table", "Figure": "body"}
HANDWRITING_TYPES = ("standalone_note", "annotation", "signature", "table_fill")
HANDWRITING_THRESHOLD = 0.4
LAYOUT_MODEL, LAYOUT_THRESHOLD = "lp://PubLayNet/faster_rcnn_R_50_FPN_3x/config", 0.5


def layoutparser(model: str = LAYOUT_MODEL, threshold: float = LAYOUT_THRESHOLD) -> engines.Engine:
    import layoutparser as library

    names = dict(enumerate(LAYOUT_TYPES))
    detector = library.Detectron2LayoutModel(config_path=model, extra_config=["MODEL.ROI_HEADS.SCORE_THRESH_TEST", threshold], label_map=names)

    def regions(data: bytes) -> list[dict]:
        found = [(*map(int, b.coordinates), LAYOUT_TYPES.get(b.type, "unknown"), 100.0 * float(b.score)) for b in detector.detect(np.asarray(_image(data)))]
        return [dict(zip(("x0", "y0", "x1", "y1", "block_type", "confidence"), f, strict=True)) for f in sorted(found, key=lambda f: (f[1] // 50, f[0]))]

    return lambda values: [regions(v) for v in values]


def yolov8(path: str, threshold: float = HANDWRITING_THRESHOLD) -> engines.Engine:
    """Handwriting regions by a fine-tuned model at `path`; register it as `engines.register("layout", "yolov8", partial(yolov8, path))`."""
    from ultralytics import YOLO

    model = YOLO(path)

    def regions(data: bytes) -> list[dict]:
        image = _image(data)
        wide, high = image.size
        found = []
        for result in model(image, conf=threshold, verbose=False):
            for box in result.boxes:
                x0, y0, x1, y1 = (int(v) for v in box.xyxy[0].tolist())
                kind = dict(enumerate(HANDWRITING_TYPES)).get(int(box.cls[0]), "unknown")
                found.append({"x0": max(0, x0), "y0": max(0, y0), "x1": min(wide, x1), "y1": min(high, y1), "block_type": kind, "confidence": float(box.conf[0])})
        return sorted(found, key=lambda f: (f["y0"] // 60, f["x0"]))

    return lambda values: [regions(v) for v in values]


_LIBRARIES = {
    ("ocr", "paddle"): paddle, ("ocr", "tesseract"): tesseract, ("htr", "trocr"): trocr, ("htr", "tesseract_devanagari"): tesseract_devanagari, ("asr", "whisper"): whisper, ("asr", "faster_whisper"): faster_whisper,
    ("embed", "sentence_transformer"): sentence_transformer, ("embed", "gemini"): gemini_embedding, ("llm", "gemini"): gemini, ("pdf", "pymupdf"): pymupdf, ("language", "langdetect"): langdetect,
    ("layout", "layoutparser"): layoutparser,
}


def register_all() -> None:
    for (kind, name), factory in _LIBRARIES.items():
        engines.register(kind, name, factory)
