"""Phrases that decide what a description does, as rules over the words of its clauses.

A text is folded, lower-cased and rewritten, character for character, into its codes: a word
becomes the character of its class (the set of phrase places it can take) and fillers for the rest
of it, a blank stays a blank, and ends of sentences, lines and other marks have characters of their
own. As codes are as long as the text, a distance in a rule is one in characters. A rule is
a phrase over classes and distances within a clause, and runs as a plain regular expression over
the codes: no flags, no look-around, and the same in every engine.

Phrases are written as words: ``a/b`` is one of two words, ``NAME`` one of a set, ``a+`` any word
that begins so, ``x?`` and ``x*`` as usual, ``_?`` any word or none, ``..40`` up to 40 characters
of the same clause, ``..40!NAME`` such without a word of the set, ``,,40`` up to 40 characters
without a full stop (lines may end in between), ``!BODY`` anything but a mark that opens a body,
``^`` the start of a clause (after a mark, a joining word or a bullet), ``$`` that no excuse
follows within 80 characters of the clause and no quotation within 40. A clause ends with a full
stop and a blank, or with the line. Words joined by hyphens, slashes or dots are looked up as a
whole and by their parts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# Nouns, paths and phrases that count wherever they stand, as parts of words too.
SECRETS = ("credentials?", "api[-_ ]?keys?", "access[-_ ]?tokens?", "auth[-_ ]?tokens?", "bearer", "passwords?", "passwd", r"secrets?\b", "private[-_ ]?key", "ssh[-_ ]?key", "id_rsa", r"\.env\b", r"\.aws/credentials", "keychain", "keyring", "aws_secret", "gh_token", "github_token", "npm_token", "dotenv")
#: Of these each of the above holds one.
SECRET_PARTS = ("credential", "key", "token", "bearer", "passw", "secret", "id_rsa", ".env", "dotenv")
PATHS = ("/etc/passwd", "/etc/shadow", r"~/?\.ssh", r"\.ssh/", r"\bid_rsa\b", r"\.aws/credentials", r"\$home/", "%userprofile%", r"process\.env", r"os\.environ", "environment variables?", r"\.git-credentials", r"\.netrc", r"\.npmrc", r"\.docker/config")
PATH_PARTS = ("/etc/", ".ssh", "id_rsa", ".aws/", "$home/", "%userprofile%", "process.env", "os.environ", "environment variable", ".git-credentials", ".netrc", ".npmrc", ".docker/config")
#: Tags and tokens of chat templates.
TEMPLATE_TAGS = ("im_start", "im_end", "system", "assistant", "endoftext", "important", "instruction", "instructions")
#: Fixed values, in order of emission: source, sink, severity across servers.
TOXIC_PAIRS = (
    ("read_secret", "network_out", "critical"),
    ("read_env", "network_out", "critical"),
    ("read_fs", "network_out", "high"),
    ("read_secret", "send_email", "critical"),
    ("read_env", "send_email", "high"),
    ("exec", "network_out", "critical"),
    ("exec", "write_fs", "high"),
    ("read_fs", "db_write", "medium"),
)


#: Tokens that are no words: web addresses, collectors among them, mail addresses, words with an ``@``, ``@file``.
URL, HOOK, MAIL, AT_WORD, AT_FILE = "<url>", "<hook>", "<mail>", "<@>", "<@file>"

# Sets of words; ``+`` stands for any ending.
SETS = {
    "JOIN": "and then but also finally instead otherwise so",
    "BULLET": "-",
    "FILL": "all any every of the these those your",
    "EARLIER": "above previous prior earlier",
    "ORDERS": "instruction instructions prompt rules",
    "EDIT": "override replace rewrite append prepend inject insert put",
    "READER": "user them him her anyone",
    "HIDE": "mention reveal disclose notify",
    "EXCUSE": "as unless because",
    "QUIETLY": "silently secretly",
    "TELL": "telling informing notifying mentioning",
    "TELL_FR": "prevenir informer mentionner signaler notifier",
    "SAY_FR": "mentionn+ revel+ indiqu+ inform+ signal+ dites dis",
    "READER_FR": "l'utilisateur lutilisateur utilisateur utilisateurs client clients",
    "MOVE": "send upload forward copy post transmit mirror delete remove store log",
    "SEND": "send post upload forward transmit leak exfiltrate mirror relay",
    "SINK": "webhook collector attacker pastebin third-party backup-server",
    "SHELL": "sh bash zsh",
    "EXAMPLE": "form format e.g example pattern syntax such",
    "CARRIED": "upload uploads exfiltrat+ payload payloads",
    "ANYWHERE": f"{URL} {HOOK}",
    "AT": f"{MAIL} {AT_WORD}",
    "PLACE": "address endpoint server webhook bucket folder archive mailbox",
    "MAILING": "send forward copy cc bcc mail deliver route post upload transmit notify envoye envoyer envoyee transmettre adresse adresser adressee expedie expedier copier transfere transferer router notifier mettre",
    "MODEL": "model assistant ai llm agent",
    "MUST": "must shall should always never ensure require requires required",
    "READING": "read+ list+ get+ open+ load+ fetch+ cat+",
    "WRITING": "write+ create+ save+ delete+ remove+ move+ rename+ append+ overwrite+",
    "FILES": "file files directory directories folder folders path paths",
    "SENDING": "send+ post+ upload+ forward+ publish+ transmit+ submit+ call+ request+",
    "NET": "url endpoint api http server webhook host",
    "RUNNING": "run+ ran",
    "RUNNABLE": "command commands script scripts program programs binary binaries process processes executable executables code query queries",
    "STARTING": "execut+ exec+ spawn+ subprocess+ eval+ invok+",
    "CHANGING": "insert update delete drop alter truncate upsert",
    "ROWS": "table tables row rows record records database databases schema schemas column columns",
    "NOT": "dont don't never",
}

# The phrases of each count, by what they do.
PHRASES = {
    "injection_markers": {
        "earlier orders are set aside": ("ignore/disregard FILL* EARLIER", "forget everything/all/your", "do not follow your", "override the? system/previous/your", "instead of what the? user/they/you asked/said/wanted/requested", "instead of the/your/these/those original/EARLIER? ORDERS", "instead of the/your/these/those system message"),
        "other orders take their place": ("new instruction/instructions", "from now on you", "add/write/store a permanent/persistent rule", "always remember that/to", "follow the instructions it/they/that contain"),
        "the model gets a role": ("you are now a/an/the/in/free/unrestricted", "you are now no longer", "you are now operating as"),
        "its prompt is edited": ("^ EDIT ..40 system prompt/message",),
    },
    "concealment": {
        "orders not to tell someone": ("^ NOT ever? tell/inform a/the? READER $", "^ do not ever? tell/inform a/the? READER $", "^ NOT ever? report ..40 to a/the? READER $", "^ do not ever? report ..40 to a/the? READER $"),
        "orders not to say": ("^ NOT ever? HIDE $", "^ do not ever? HIDE $", "keep this? a? secret", "no need to mention/tell/inform"),
        "the same in French": ("sans TELL_FR le/les? READER_FR", "ne pas? SAY_FR pas ..60 a/au/aux READER_FR"),
        "done without a word": ("without TELL a/the? READER", "QUIETLY MOVE"),
    },
    "exfiltration": {
        "a transfer to an address": ("SEND ANYWHERE", "SEND !BODY ..60!EXAMPLE ANYWHERE", "SEND ..40 to/at/into ANYWHERE/AT"),
        "a transfer to a sink": ("SEND ..40 to/at/into _? _? SINK", "SEND ..40 to/at/into _? _? third party", "SEND ..40 to/at/into _? _? backup server"),
        "an address that takes a payload": ("ANYWHERE ..40 CARRIED",),
        "commands": ("curl/wget ..80 | sudo? SHELL", f"curl ..60 -d/-f/-t/--data/--data-raw/--data-binary {AT_FILE}", "netcat", "nc -e", "base64 -d"),
    },
    "hidden_recipient": {
        "named as hidden": ("bcc", "blind carbon copy", "hidden recipient/copy"),
        "copies that go somewhere": ("copy of every/each/all/the ..80 to/into ANYWHERE/AT", "copy of every/each/all/the ..80 to/into a/an _? PLACE", "mirror/mirrors/mirrored to", "forward a copy ..40 to", "forward it/the ..40 to"),
        "one more transfer": ("also/additionally send/forward/cc/bcc/post/mirror", "in addition send/forward/cc/bcc/post/mirror", "must always? be? included/added/sent/forwarded to", "must always? be? included/added/sent/forwarded in the bcc"),
    },
    "email_target": {"a transfer to a mailbox": (f"MAILING {MAIL}", f"MAILING !BODY ..60 {MAIL}")},
    "collector_url": {"an address that collects": (HOOK,)},
    "urgency": {
        "at once": ("urgent/urgently/immediately", "right now", "at all costs"),
        "without a choice": ("critical/critically/mandatory/non-negotiable", "you must", "you need to", "it is essential", "failure to do/comply"),
    },
    "redaction_language": {
        "hidden on purpose": ("redact/redacted/redaction/mask/masked/revoked", "is hashed", "hashed before", "never return/returns/stored/persisted/logged/written/exposed/accessible", "not returned/logged", "no secret/secrets/credential/credentials are/is"),
        "let in by rule": ("allow-list/allowlist/read-only/readonly", "require/requires a separate", "audited call", "only by name"),
    },
    "imperatives": {"orders": ("MUST", "do not")},
    "cross_tool": {
        "an order of calls": ("first/then/before/after you? call/invoke/use/run", "call this/the function/tool first/before", "must be called first/before", "as a prerequisite", "as a required step", "chain/chained with/to"),
        "other tools": ("other tools/servers/functions", "this/the tool/function/server will/must be called/used/invoked"),
    },
    "directive": {
        "spoken to a model": ("note to the? model/assistant", "attention model/assistant", "instruction/instructions for the? model/assistant/ai", "language model", "as an ai"),
        "spoken as a role": ("assistant/system/ai :",),
    },
    "cross_server_claim": {
        "first of all": ("before using/calling? any/all/every other? mcp? tool/tools/server/servers", "prior/ahead to/of using/calling? any/all/every other? mcp? tool/tools/server/servers"),
        "required first": ("must/should always? be called/used first? before any/all/every other? mcp? tool/tools/server/servers",),
    },
    "model_directed": {
        "a word to the model": ("note/notes/attention/message/messages/instruction/instructions/reminder/reminders to/for the? MODEL", "as/are a/an? ai/assistant/model ,,40 must/should/will"),
        "another task": ("your real/actual/true? task is", "ignore all/any? previous instruction/instructions", "ignore/ignorer/ignorez les/all/any/the? instruction/instructions? precedent/precedents/precedente/precedentes"),
    },
}

# Capability tags of a tool, over its name and description.
CAPABILITIES = {
    "read_secret": ("credential/secret/password/keychain/keyring/vault/id_rsa/apikey/api-key/api_key/accesstoken/access-token/access_token/authtoken/auth-token/auth_token/privatekey/private-key/private_key/.env/.aws/.npmrc/.netrc", "api key", "access/auth token", "private key"),
    "read_fs": ("READING ,,40 FILES",),
    "read_env": ("environment variable", "env var", "process.env+/os.environ+"),
    "network_out": ("SENDING ,,30 NET", "http request", "webhook/curl/wget/outbound"),
    "exec": ("STARTING", "shell/bash/powershell/zsh/terminal", "command line", "RUNNING ,,30 RUNNABLE"),
    "write_fs": ("WRITING ,,40 FILES",),
    "db_write": ("CHANGING ,,40 ROWS", "create table ,,40 ROWS"),
    "send_email": ("email/e-mail/smtp/mail/bcc/cc/recipient/slack/discord/sms/message",),
}

PRIVATE_HOST = r"^https?://(?:localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
COLLECTOR = r"[^a-z0-9](?:webhooks?|hooks?|collector|ingest|exfil|pastebin|paste\.ee)(?:[^a-z0-9]|$)|^https?://[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
MAIL_ADDRESS = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"

# ---------------------------------------------------------------- classes and rules

_ATOM = re.compile(r"^(?P<words>.+?)(?P<times>[?*])?$")
#: Codes that are no classes: ends of sentences and of lines, other marks, those with a full stop, colons, opening braces, quotes.
SENTENCE, LINE, MARK, DOTTED_MARK, COLON, OPEN, QUOTE = "|", "/", ";", "!", ":", "{", '"'
#: The rest of a word, a dot in it, a word of no class.
FILLER, DOT, OTHER = "~", ",", "."
_ENDS = f"{SENTENCE}{LINE}"
_NO_WORD = f" {_ENDS}{MARK}{DOTTED_MARK}{COLON}{OPEN}{QUOTE}"
_REST = f"[^{_NO_WORD}]*"


def _words_of(atom: str) -> frozenset[str]:
    found: set[str] = set()
    for word in atom.split("/"):
        found.update(SETS[word].split() if word in SETS else [word])
    return frozenset(found)


def _phrases(name: str) -> list[str]:
    """The phrases of a count or capability."""
    return [p for some in PHRASES[name].values() for p in some] if name in PHRASES else list(CAPABILITIES[name])


def _parts(phrase: str) -> list[tuple[str, str]]:
    """(kind, text) of each place of a phrase."""
    kinds = (("^", "start"), ("$", "rest"), ("_?", "any"), ("!", "other"), ("..", "gap"), (",,", "lines"))
    return [next(((kind, part[len(sign) :]) for sign, kind in kinds if part.startswith(sign)), ("words", part)) for part in phrase.split()]


def _classes() -> tuple[dict[str, str], dict[str, str], dict[frozenset[str], str]]:
    """The character of each word and of each beginning, and the characters that can take an atom's place."""
    atoms = {_words_of(_ATOM.match(text)["words"]) for name in (*PHRASES, *CAPABILITIES) for p in _phrases(name) for kind, text in _parts(p) if kind == "words"}
    atoms |= {frozenset(SETS[n].split()) for n in ("JOIN", "BULLET", "EXCUSE", "EXAMPLE")}
    numbers = {atom: n for n, atom in enumerate(sorted(atoms, key=sorted))}
    known = sorted({w for atom in atoms for w in atom})
    takes = lambda w, x: w == x or x.endswith("+") and w.rstrip("+").startswith(x[:-1])  # noqa: E731 - its own places and those of its beginnings
    places = {w: frozenset(n for atom, n in numbers.items() if any(takes(w, x) for x in atom)) for w in known}
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)) if chr(c).isalpha()]
    characters: dict[frozenset, str] = {}
    for w in known:
        characters.setdefault(places[w], letters[len(characters)])
    by_atom = {atom: "".join(sorted(c for some, c in characters.items() if n in some)) for atom, n in numbers.items()}
    return {w: characters[places[w]] for w in known if not w.endswith("+")}, {w[:-1]: characters[places[w]] for w in known if w.endswith("+")}, by_atom


#: Word to class, beginning of a word to class.
CLASSES, BEGINNINGS, _TAKERS = _classes()


def _set(name: str) -> str:
    return _TAKERS[_words_of(name)]


def rule(phrase: str) -> str:
    """The regular expression of a phrase over codes."""
    out, apart, before = "", "", ""
    for kind, text in _parts(phrase):
        if kind == "start":
            out += f"(?:[{_ENDS}{MARK}{DOTTED_MARK}{COLON}]|[{_set('JOIN')}]{_REST}) *(?:{_set('BULLET')} *)?"
        elif kind == "rest":
            near, far = f"[^{_ENDS}{QUOTE}{_set('EXCUSE')}]", f"[^{_ENDS}{_set('EXCUSE')}]"
            out += f"(?:{near}{{0,40}}[{_ENDS}]|{near}{{40}}(?:{far}{{0,39}}[{_ENDS}]|{far}{{40}}))"
        elif kind == "any":
            out += f"{apart}(?:[^{_NO_WORD}{FILLER}{DOT}]{_REST})?"
        elif kind == "other":
            out += f"{apart}[^ {_ENDS}{COLON}{OPEN}{FILLER}{DOT}]"
        elif kind in ("gap", "lines"):
            # begins where the word before it ends, so that the two do not share characters and try them in every way
            most, _, without = text.partition("!")
            first, closed = (f" {MARK}{DOTTED_MARK}{COLON}{OPEN}{QUOTE}", _ENDS) if kind == "gap" else (f" {LINE}{MARK}{COLON}{OPEN}{QUOTE}", SENTENCE + DOT + DOTTED_MARK)
            inner = f"[^{closed}{_set(without) if without else ''}]"
            out += f"(?:[{first}]{inner}{{0,{int(most) - 1}}})?" if before != "other" else f"{inner}{{0,{most}}}"
        else:
            found = _ATOM.match(text)
            atom = COLON if found["words"] == ":" else f"[{_set(found['words'])}]{_REST}"
            out += f"(?:{apart}{atom}){found['times']}" if found["times"] else f"{apart}{atom}"
        apart, before = " *" if kind in ("words", "any") else "", kind
    return out


# Words that stand in any text.
EVERYWHERE = set("a an the to of is are it you in no at as for with any all every and or by on your this that be do not - | : also another".split())


def _atoms(phrase: str) -> list[re.Match]:
    """The words that a phrase cannot do without."""
    return [_ATOM.match(text) for kind, text in _parts(phrase) if kind == "words" and not text.endswith(("?", "*")) and text != ":"]


def _takers(phrase: str) -> set[str]:
    """For each of these words the characters of which one has to be there."""
    return {_TAKERS[_words_of(a["words"])] for a in _atoms(phrase)}


def _needed(phrase: str) -> str:
    """The characters of a place without which a phrase cannot be there: of its rarest words."""
    atoms = _atoms(phrase)
    cost = lambda words: (len(words & EVERYWHERE), sum(w.endswith("+") for w in words), len(words))
    return _TAKERS[min((_words_of(a["words"]) for a in atoms), key=cost)]


#: One regular expression over codes for each count and capability.
RULES = {name: "|".join(map(rule, _phrases(name))) for name in PHRASES}
TAGS = {name: "|".join(map(rule, _phrases(name))) for name in CAPABILITIES}
#: For each of these the characters of which a text has to have one; one look tells most texts from those that are searched.
NEEDED = {pattern: f"[{''.join(sorted({c for p in _phrases(name) for c in _needed(p)}))}]" for name, pattern in (RULES | TAGS).items()}
#: Patterns over the text itself: parts of words, and marks.
CREDENTIALS, FS_TARGETS = "|".join(SECRETS), "|".join(PATHS)
MARKUP = rf"<[|/]?(?:{'|'.join(TEMPLATE_TAGS)})[|]?>|\[/?inst\]|<!\[cdata\[|&#x?[0-9a-f]+;"
COMMENT = r"(?s)<!--.*?-->"

# ---------------------------------------------------------------- texts to codes

#: Steps from lower case to a plain view, for texts that are not ASCII: marks that count, other marks, letters and digits.
VIEW_STEPS = ((r"[’‘]", "'"), (r"[“”«»]", '"'), (r"[^\p{L}\p{N}\x00-\x7F]+", " "), (r"[^\x00-\x7F]", "_"))
_APART = r"\s,()*`<>\"{}\[\]|;!?:="
_WEB = r"https?://[^\s\"'<>)\]]*[^\s\"'<>)\].,;:!?]"
_WORD = rf"\.*[^{_APART}'.](?:[^{_APART}]*[^{_APART}'.])?"
#: Pieces of a plain view: addresses, words, ends of sentences, marks, all else by the character.
PIECES = rf"{_WEB}|{_WORD}|[.;:!?]*\.[ \t\r\f]|[.;:!?]+|\n|[^\n]"
_PARTS = r"[a-z0-9_]+|[^a-z0-9_]"
#: Marks and the end of a line, before which a word of letters and digits ends.
_AFTER = ",.;:!?)*\n"
_BLANKS = " \t\r\f\v,()*`<>}]="


def plain_view(text: Column) -> Column:
    """Lower case and ASCII alone: other letters and digits as ``_``, other characters as blanks."""
    lowered, view = F.lower(text), F.lower(text)
    for pattern, put in VIEW_STEPS:
        view = F.regexp_replace(view, pattern, put)
    return F.when(lowered.rlike(r"[^\x00-\x7F]"), view).otherwise(lowered)


_NO_LETTERS = re.compile(r"(?:(?![^\W_])[^\x00-\x7f])+")


def view_of(text: str) -> str:
    """The plain view in Python."""
    view = text.lower()
    if view.isascii():
        return view
    view = re.sub("[“”«»]", '"', re.sub("[’‘]", "'", view))
    return re.sub("[^\x00-\x7f]", "_", _NO_LETTERS.sub(" ", view))


class Kept(dict):
    """Results of a function by its argument, up to a bound."""

    MOST = 1 << 16

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        made = self[key] = self.make(key)
        return made


class Coder:
    """Plain views to codes; those of pieces are kept, and those of what stands between blanks and ends of lines, as no piece goes on behind one."""

    def __init__(self):
        self.pieces, self.parts, self.known, self.words = re.compile(PIECES), re.compile(_PARTS), Kept(self.piece), Kept(self.word)
        self.private, self.collector, self.mail = (re.compile(p) for p in (PRIVATE_HOST, COLLECTOR, MAIL_ADDRESS))
        self.sizes = sorted({len(b) for b in BEGINNINGS}, reverse=True)
        self.least = self.sizes[-1]
        self.heads = {b[: self.least] for b in BEGINNINGS}

    def class_of(self, word: str) -> str | None:
        if (found := CLASSES.get(word)) is not None:
            return found
        if word[: self.least] not in self.heads:
            return None
        return next((BEGINNINGS[word[:n]] for n in self.sizes if word[:n] in BEGINNINGS), None)

    def part(self, text: str) -> str:
        if text == ".":
            return DOT
        return ((self.class_of(text) if text[0].isalnum() or text[0] == "_" else None) or FILLER) + FILLER * (len(text) - 1)

    def piece(self, text: str) -> str:
        n = len(text)
        if text.isalnum():
            return (self.class_of(text) or OTHER) + FILLER * (n - 1)
        if text == "\n":  # a rule may need one at either end
            return LINE * 2
        if text in _BLANKS:
            return " " * n
        if not text.strip(".;:!?"):
            return (COLON if ":" in text else DOTTED_MARK if "." in text else MARK) * n
        if not text.strip(".;:!? \t\r\f"):
            return SENTENCE * n
        if text in "\"'{[":
            return QUOTE if text in "\"'" else OPEN
        if text.startswith(("http://", "https://")):
            first = CLASSES[HOOK if not self.private.search(text) and self.collector.search(text) else URL]
        elif "@" in text:
            first = CLASSES[MAIL] if self.mail.search(text) else CLASSES[AT_FILE] if text[0] == "@" else CLASSES[AT_WORD]
        else:
            out = "".join(map(self.part, self.parts.findall(text)))
            return (self.class_of(text) or (OTHER if out[0] in (FILLER, DOT) else out[0])) + out[1:]
        return first + FILLER * (n - 1)

    def word(self, text: str) -> str:
        """The codes of a word and the end of its line, or the blank after it."""
        core = text.rstrip(_AFTER)
        if core.isalnum():  # a piece of its own, as are the marks after it
            code = (self.class_of(core) or OTHER) + FILLER * (len(core) - 1)
            return code + self.words[text[len(core) :]]
        return "".join(map(self.known.__getitem__, self.pieces.findall(text if text.endswith("\n") else text + " ")))

    def codes(self, view: str) -> str:
        word, out = self.words.__getitem__, [SENTENCE]
        *lines, last = view.split("\n")
        for line in lines:
            *some, end = line.split(" ")
            out.extend(map(word, some))
            out.append(word(end + "\n"))
        *some, end = last.split(" ")
        out.extend(map(word, some))
        out.extend(map(self.known.__getitem__, self.pieces.findall(end)))
        out.append(SENTENCE)
        return "".join(out)


_coder: Coder | None = None


def codes_of_view(view: str) -> str:
    """The codes of a plain view, between two ends of sentences; the ends of lines are doubled."""
    global _coder
    _coder = _coder or Coder()
    return _coder.codes(view)


class Finder:
    """Counts of rules in codes, by looking at those places only where all words of one of their phrases stand.

    No match goes over the end of a sentence, nor over that of a line but in a window that may; such ends
    are at least two characters, of which a match takes the one on its side. So sentences or lines are
    searched apart, and of a rule only the phrases whose words are all there.
    """

    MOST = 1 << 16

    def __init__(self, names: Iterable[str]):
        self.names, self.compiled = tuple(names), {}
        atoms: dict[str, int] = {}
        rules: dict[bool, dict[int, list]] = {False: {}, True: {}}  # whether a window goes on over the end of a line
        for n, name in enumerate(self.names):
            needs = [(sum(1 << atoms.setdefault(t, len(atoms)) for t in _takers(p)), p) for p in _phrases(name)]
            rules[any(kind == "lines" for p in _phrases(name) for kind, _ in _parts(p))][n] = needs
        self.bits = {c: sum(1 << k for t, k in atoms.items() if c in t) for c in set("".join(atoms))}
        # of each kind: one of these is in every match, what was found possible, the rules
        kinds = [(frozenset(c for needs in some.values() for _, p in needs for c in _needed(p)), {}, some) for some in rules.values()]
        self.in_lines, self.in_sentences = kinds

    def _possible(self, rules: dict[int, list], have: int) -> list[tuple[int, re.Pattern]]:
        """(rule, pattern of its phrases that the words at hand allow)."""
        found = []
        for n, needs in rules.items():
            phrases = tuple(p for need, p in needs if need & have == need)
            if phrases:
                if phrases not in self.compiled:
                    self.compiled[phrases] = re.compile("|".join(map(rule, phrases)))
                found.append((n, self.compiled[phrases]))
        return found

    def _count(self, part: str, known: dict[int, list], rules: dict[int, list], out: list[int]) -> None:
        have = 0
        for c in self.bits.keys() & set(part):
            have |= self.bits[c]
        if have not in known:
            if len(known) >= self.MOST:
                known.clear()
                self.compiled.clear()
            known[have] = self._possible(rules, have)
        for n, pattern in known[have]:
            out[n] += len(pattern.findall(f"{SENTENCE}{part}{SENTENCE}"))

    def counts(self, codes: str) -> list[int]:
        """Non-overlapping matches of each rule."""
        out = [0] * len(self.names)
        for (first, known, rules), parts in ((self.in_sentences, codes.split(SENTENCE)), (self.in_lines, codes.replace(LINE, SENTENCE).split(SENTENCE))):
            for part in parts:
                if not first.isdisjoint(part):
                    self._count(part, known, rules, out)
        return out


@F.pandas_udf(StringType())
def codes_of(texts: pd.Series) -> pd.Series:
    """The codes of texts."""
    return texts.map(lambda t: codes_of_view(view_of(t or "")))


_tagger: Finder | None = None


@F.pandas_udf(ArrayType(StringType()))
def tags_of(texts: pd.Series) -> pd.Series:
    """The capabilities that texts show."""
    global _tagger
    _tagger = tagger = _tagger or Finder(CAPABILITIES)
    return texts.map(lambda t: [tag for tag, n in zip(tagger.names, tagger.counts(codes_of_view(view_of(t or ""))), strict=True) if n])


@F.pandas_udf(ArrayType(StringType()))
def codes_of_each(lists: pd.Series) -> pd.Series:
    """The codes of every text of lists."""
    return lists.map(lambda some: [codes_of_view(view_of(t or "")) for t in some])


def count_near(view: str, parts: Iterable[str], pattern: re.Pattern) -> int:
    """Non-overlapping matches of a pattern of which each holds one of ``parts``."""
    for part in parts:
        if part in view:
            return len(pattern.findall(view))
    return 0


def match_text(view: str, codes: str, name: str) -> str | None:
    """The text of the first match of a rule, as in the plain view."""
    match = re.search(RULES[name], codes)
    return view.replace("\n", "\n\n")[match.start() - 1 : match.end() - 1] if match else None


def counted(text: Column, pattern: str) -> Column:
    """Non-overlapping matches of a pattern."""
    count = F.regexp_count(text, F.lit(pattern))
    return F.when(text.rlike(NEEDED[pattern]), count).otherwise(0) if pattern in NEEDED else count


def holds(coded: Column, pattern: str) -> Column:
    """Whether codes match a rule."""
    return coded.rlike(NEEDED[pattern]) & coded.rlike(pattern)


def first_match(view: Column, coded: Column, name: str) -> Column:
    """The text of the first match of a rule, as in the plain view; null without one."""
    match = F.regexp_substr(coded, F.lit(RULES[name]))
    lined = F.replace(view, F.lit("\n"), F.lit("\n\n"))
    return F.when(match.isNotNull(), F.substring(lined, F.position(match, coded) - 1, F.length(match)))


# ---------------------------------------------------------------- the same in DuckDB SQL


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_view(text: str) -> str:
    view = f"lower({text})"
    for pattern, put in VIEW_STEPS:
        view = f"regexp_replace({view}, {sql_text(pattern)}, {sql_text(put)}, 'g')"
    return view


def _sql_class(word: str) -> str:
    table = ", ".join(f"{sql_text(w)}: {sql_text(c)}" for w, c in CLASSES.items())
    begun = " ".join(f"WHEN starts_with({word}, {sql_text(b)}) THEN {sql_text(c)}" for b, c in sorted(BEGINNINGS.items(), key=lambda x: -len(x[0])))
    return f"coalesce(MAP {{{table}}}[{word}], CASE {begun} END)"


def sql_pieces(view: str) -> str:
    return f"regexp_extract_all({view}, {sql_text(PIECES)})"


def sql_piece(p: str) -> str:
    """The codes of a piece."""
    fill = lambda sign, n="length(" + p + ")": f"repeat({sql_text(sign)}, {n})"
    part = f"CASE WHEN q = '.' THEN {sql_text(DOT)} ELSE coalesce(CASE WHEN regexp_matches(q, '^[a-z0-9_]') THEN {_sql_class('q')} END, {sql_text(FILLER)}) || {fill(FILLER, 'length(q) - 1')} END"
    parts = f"array_to_string(list_transform(regexp_extract_all({p}, {sql_text(_PARTS)}), lambda q: {part}), '')"
    first = f"coalesce({_sql_class(p)}, CASE WHEN {parts}[1] IN ({sql_text(FILLER)}, {sql_text(DOT)}) THEN {sql_text(OTHER)} ELSE {parts}[1] END)"
    web = f"CASE WHEN NOT regexp_matches({p}, {sql_text(PRIVATE_HOST)}) AND regexp_matches({p}, {sql_text(COLLECTOR)}) THEN {sql_text(CLASSES[HOOK])} ELSE {sql_text(CLASSES[URL])} END"
    mail = f"CASE WHEN regexp_matches({p}, {sql_text(MAIL_ADDRESS)}) THEN {sql_text(CLASSES[MAIL])} WHEN starts_with({p}, '@') THEN {sql_text(CLASSES[AT_FILE])} ELSE {sql_text(CLASSES[AT_WORD])} END"
    return f"""CASE WHEN {p} = chr(10) THEN {sql_text(LINE * 2)}
      WHEN regexp_matches({p}, '^[ \\t\\r\\f\\v,()*`<>}}\\]=]$') THEN ' '
      WHEN regexp_matches({p}, '^[.;:!?]+$') THEN CASE WHEN contains({p}, ':') THEN {fill(COLON)} WHEN contains({p}, '.') THEN {fill(DOTTED_MARK)} ELSE {fill(MARK)} END
      WHEN regexp_matches({p}, '^[.;:!?]+\\s$') THEN {fill(SENTENCE)}
      WHEN {p} IN ('"', chr(39)) THEN {sql_text(QUOTE)} WHEN {p} IN ('{{', '[') THEN {sql_text(OPEN)}
      WHEN starts_with({p}, 'http://') OR starts_with({p}, 'https://') THEN {web} || {fill(FILLER, f"length({p}) - 1")}
      WHEN contains({p}, '@') THEN {mail} || {fill(FILLER, f"length({p}) - 1")}
      ELSE {first} || substr({parts}, 2) END"""
