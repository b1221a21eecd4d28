"""Terms that give a diagnosis away or were left by processing; the clinical stage deletes them from reports."""

from __future__ import annotations

#: Patterns in the order in which they are deleted, each applied to what the ones before it leave.
DIAGNOSIS_TERMS = (
    r"melanoma in situ",
    r"melanoma stage ia",
    r"malignant melanoma",
    r"superficial melanoma",
    r"melanoma",
    r"dysplastic nevus",
    r"melanocytic nevus",
    r"compound nevus",
    r"junctional nevus",
    r"nevus",
    r"clark(?:\s+level)?\s*:?\s*[ivxIVX0-9]*",
    r"nivel\s+[ivxIVX0-9]+\s+de\s+clark",
    r"nivel\s+[ivxIVX0-9]+\s+de\s+clark[^.]*",
    r"breslow[^.]*?mm",
    r"breslow",
    r"[0-9]+[.,][0-9]+\s*mm",
    r"mitoses?\s*:?\s*[0-9x\s]+mm[²³]?",
    r"ulceration\s*:?\s*(yes|no|present|absent)",
    r"ulceración\s*:?\s*(sí|no|presente|ausente)",
    r"superficial spreading",
    r"extensión superficial",
    r"N[0-9]\b",
    r"pT[0-9is][abc]?",
    r"ptis",
    r"pathological stage[^.]*",
    r"stage i[ab]?",
    r"radial growth[^.]*",
    r"vertical growth[^.]*",
    r"horizontal growth[^.]*",
    r"growth phase[^.]*",
    r"in[\s\-]situ",
    r"pagetoid[^.]*",
    r"regression[^.]*",
    r"invol[a-z]+[^.]*",
    r"ulcerat[a-z]*[^.]*",
    r"no ulceration[^.]*",
    r"invasive[^.]*",
    r"acral[^.]*",
    r"lentiginoso[^.]*",
    r"follicular epithelium[^.]*",
    r"reticular dermis[^.]*",
    r"periadventitial dermis[^.]*",
    r"microsatellitosis",
    r"vascular or lymphatic invasion[^.]*",
    r"lymphatic invasion[^.]*",
    r"vascular invasion[^.]*",
    r"perineural invasion[^.]*",
    r"angioinvasion[^.]*",
    r"angiolinfatic invasion[^.]*",
    r"tumor thickness[^.]*",
    r"maximum thickness[^.]*",
    r"maximum invasion depth[^.]*",
    r"maximum infiltration depth[^.]*",
    r"mitotic index[^.]*",
    r"mitosis per mm[^.]*",
    r"[0-9]+\s*(?:μm|micras|microns)[^.]*",
    r"infiltrat[a-z]*\s+the\s+papillary\s+dermis[^.]*",
    r"papillary dermis[^.]*",
    r"dermal infiltration[^.]*",
    r"dermal tissue infiltration[^.]*",
    r"dermal tissue invasion[^.]*",
    r"dermal invasion[^.]*",
    r"lentigo maligno[^.]*",
    r"lentiginous[^.]*",
    r"acral lentiginous[^.]*",
    r"malignant[^.]*",
    r"maligno[^.]*",
    r"melan[\-\s]?a\s+positive[^.]*",
    r"hmb[\-\s]?45[^.]*",
    r"melanocytic dysplasia[^.]*",
    r"dysplasia[^.]*",
    r"epidermal migration of melanin[^.]*",
    r"ausencia de ulceraci[oó]n[^.]*",
    r"sin ulceraci[oó]n[^.]*",
    r"dysplastic changes",
    r"dysplastic features",
    r"dysplastic",
    r"displastic[^.]*",
    r"displás[a-z]*[^.]*",
    r"displasico[^.]*",
    r"peritumoral",
    r"\[text appears truncated\]",
    r"I\.T\.?\s*(?:MDC|SMC|JBC|[A-Z]{1,3})?",
    r"\bIT\b\s*(?:MDC|SMC|JBC)?",
    r"I\.P\.?\s*(?:in cross[^.]*)?",
    r"\bIP\b\s*(?:in cross[^.]*)?",
    r"in cross[\-\s]?section[^.]*",
    r"in cross[^.]*",
    r"total inclusion[^.]*",
    r"partial inclusion[^.]*",
    r"previous? IT[^.]*",
    r"previa bisec[a-záéíóú]*",
    r"(?:china|india|chinese) ink[^.]*",
    r"marking limits with[^.]*",
    r"marked with[^.]*ink[^.]*",
    r"[0-9]+[A-Z]\s+cassette[^.]*",
    r"cassette[^.]*",
    r"bisect[a-z]*[^.]*",
    r"(?:MATIAS[\-\s]GUIU|EGIDO)[^.]*",
    r"nan\s*$",
)
