"""The language of a text: its script, and where several languages share it, sequences of up to three letters of a sample of each.

A language's sequences are counted in a short text, the first article of the Universal Declaration of Human Rights; a naive Bayes estimate
over those of the text asked about gives the language and its share of the probability.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np

# The sample of each language; those of other scripts are told by their letters.
SAMPLES = {
    "english": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. You will have to be here for this with them at that time, or from which there is not what we can do by our work.",
    "german": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Wir haben hier nicht das, was sich bei uns für die Arbeit auf dem Weg oder mit einem von der Stadt ergibt, wenn es zu einer werden kann.",
    "french": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Nous avons ici pour vous ce que la ville et le travail donnent avec une personne qui est au cours du temps, ou sur cette page.",
    "spanish": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Tenemos aquí para usted lo que la ciudad y el trabajo dan con una persona que es del tiempo, o en esta página por su parte.",
    "portuguese": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Temos aqui para você o que a cidade e o trabalho dão com uma pessoa que não é do tempo, ou nesta página por sua parte.",
    "italian": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Abbiamo qui per voi quello che la città e il lavoro danno con una persona che è del tempo, o in questa pagina per la sua parte.",
    "dutch": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Wij hebben hier voor u wat de stad en het werk geven met een persoon die van de tijd is, of op deze bladzijde.",
    "swedish": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Vi har här för dig det som staden och arbetet ger med en person som inte är på den här sidan, eller av tiden.",
    "norwegian": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Vi har her for deg det som byen og arbeidet gir med en person som ikke er på denne siden, eller av tiden.",
    "danish": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Vi har her til dig det, som byen og arbejdet giver med en person, der ikke er på denne side, eller af tiden.",
    "icelandic": "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku, og ber þeim að breyta bróðurlega hverjum við annan.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "estonian": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim.",
    "latvian": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā.",
    "lithuanian": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai.",
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "czech": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "slovak": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu.",
    "croatian": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva.",
    "bosnian": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i treba da jedno prema drugome postupaju u duhu bratstva.",
    "albanian": "Të gjithë njerëzit lindin të lirë dhe të barabartë në dinjitet dhe në të drejta. Ata kanë arsye dhe ndërgjegje dhe duhet të sillen ndaj njëri tjetrit me frymë vëllazërimi.",
    "hungarian": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "romanian": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "indonesian": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "malay": "Semua manusia dilahirkan bebas dan samarata dari segi kemuliaan dan hak-hak. Mereka mempunyai pemikiran dan perasaan hati dan hendaklah bertindak di antara satu sama lain dengan semangat persaudaraan.",
    "filipino": "Ang lahat ng tao'y isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila'y pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran.",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ukrainian": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "persian": "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند.",
}
# The first and last code points of scripts, and the languages that they tell of.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x04FF, "cyrillic"), (0x0600, 0x06FF, "arabic"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "korean"), (0x3040, 0x30FF, "japanese"), (0x4E00, 0x9FFF, "chinese"), (0xAC00, 0xD7AF, "korean"),
]
SHARED = {
    "cyrillic": ["russian", "ukrainian"],
    "arabic": ["arabic", "persian"],
    "latin": [k for k in SAMPLES if k not in ("russian", "ukrainian", "arabic", "persian")],
}
#: What a sequence counts that a sample doesn't hold, and how much the evidence of sequences that overlap is discounted.
SMOOTHING, DISCOUNT = 0.2, 0.2


_LETTERS = re.compile(r"[^\W\d_]+")


def _sequences(text: str) -> dict[str, int]:
    """Sequences of one to three letters of the words of a text, with their ends, and how often they occur."""
    s = f" {' '.join(_LETTERS.findall(text.lower()))} "
    two = list(map(add, s, s[1:]))
    return Counter(chain(s, two, map(add, two, s[2:])))


@lru_cache(maxsize=4)
def _model(script: str) -> tuple[list[str], dict[str, int], np.ndarray]:
    names = SHARED[script]
    counts = [_sequences(SAMPLES[k]) for k in names]
    rows = {s: i for i, s in enumerate(sorted({s for c in counts for s in c}))}
    table = np.full((len(rows), len(names)), SMOOTHING)
    for k, c in enumerate(counts):
        for s, n in c.items():
            table[rows[s], k] += n
    return names, rows, np.log(table / (table.sum(axis=0)))


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    kinds = sorted({k for _, _, k in SCRIPTS})
    table = np.zeros(1 << 16, np.int64)
    for a, b, k in SCRIPTS:
        for c in range(a, b + 1):
            if chr(c).isalpha():
                table[c] = kinds.index(k) + 1
    return table


def script_of(text: str) -> str | None:
    """The script of most letters of a text; Japanese where a tenth of the letters is kana. None without letters of a known one."""
    kinds = [None, *sorted({k for _, _, k in SCRIPTS})]
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    n = np.bincount(_script_table()[codes], minlength=len(kinds))
    n[0] = 0
    if not n.sum():
        return None
    kana = n[kinds.index("japanese")]
    return "japanese" if kana * 10 >= n.sum() and kana + n[kinds.index("chinese")] >= n.max() else kinds[int(n.argmax())]


def language_of(text: str | None) -> tuple[str, float]:
    """The most likely language of a text and a confidence in [0, 1]; English with confidence 0 where nothing speaks for one. The whole text is read."""
    script = script_of(text or "")
    if script is None:
        return "english", 0.0
    if script not in SHARED:
        return script, 1.0
    names, rows, table = _model(script)
    found = _sequences(text)
    known = [(rows[s], n) for s, n in found.items() if s in rows]
    if not known:
        return "english", 0.0
    at, times = zip(*known)
    score = DISCOUNT * (np.sqrt(np.array(times)) @ table[list(at)])
    share = np.exp(score - score.max())
    best = int(score.argmax())
    return names[best], float(1 / share.sum())
