"""Configurations of FreeLing analyzers, made from one table of settings: key=value files, and the splitter's sections."""

from __future__ import annotations

#: Languages that an analyzer is set up for, by code.
LANGUAGES = {"en": "english", "es": "spanish", "it": "italian", "pt": "portuguese", "ru": "russian", "cy": "welsh"}

# Settings of every language.
COMMON = {
    "InputFormat": "plain", "OutputFormat": "tagged", "AlwaysFlush": "yes", "MultiwordsDetection": "no", "NumbersDetection": "no", "DatesDetection": "no",
    "QuantitiesDetection": "no", "DictionarySearch": "yes", "ProbabilityAssignment": "yes", "OrthographicCorrection": "no", "ProbabilityThreshold": "0.001",
    "NERecognition": "no", "Phonetics": "no", "NEClassification": "no", "SenseAnnotation": "none", "Tagger": "hmm", "CoreferenceResolution": "no",
    "AffixAnalysis": "yes", "PunctuationDetection": "yes", "DecimalPoint": ".", "ThousandPoint": ",", "TaggerRetokenize": "yes", "TaggerForceSelect": "tagger",
}
# Where a language's settings differ; Welsh is run as English, as it always was.
OWN = {
    "es": {"DecimalPoint": ",", "ThousandPoint": "."},
    "it": {"DecimalPoint": ",", "ThousandPoint": "."},
    "pt": {"DecimalPoint": ",", "ThousandPoint": ".", "RetokContractions": "false"},
    "ru": {"AffixAnalysis": "no", "PunctuationDetection": "no"},
    "cy": {"Lang": "en", "TaggerRetokenize": "no", "TaggerForceSelect": "none"},
}
#: Data files of a language in FreeLing's own folder.
DATA = {"TokenizerFile": "tokenizer.dat", "AffixFile": "afixos.dat", "DictionaryFile": "dicc.src", "ProbabilityFile": "probabilitats.dat", "TaggerHMMFile": "tagger.dat"}
# A sentence may end between markers, and has this many words at most; nothing else ends or begins one.
SPLITTER = {"General": ["AllowBetweenMarkers 1", "MaxWords 1000"], "Markers": ['" "', "( )", "{ }", "/* */"], "SentenceEnd": [], "SentenceStart": []}


def settings(lang: str) -> dict[str, str]:
    if lang not in LANGUAGES:
        raise ValueError(f"no configuration for language {lang!r}")
    own = {"Lang": lang} | COMMON | OWN.get(lang, {})
    return own | {key: f"$FREELINGSHARE/{lang}/{name}" for key, name in DATA.items()} | {"PunctuationFile": "$FREELINGSHARE/common/punct.dat"}


def files(lang: str) -> tuple[tuple[str, str], ...]:
    """(name, content) of a language's configuration and of the splitter's."""
    config = "".join(f"{key}={value}\n" for key, value in settings(lang).items())
    splitter = "".join(f"<{name}>\n" + "".join(f"{line}\n" for line in lines) + f"</{name}>\n" for name, lines in SPLITTER.items())
    return (f"{lang}.cfg", f"## {LANGUAGES[lang]}\n\n{config}"), ("generic_splitter.dat", splitter)
