"""Licence scans: known licence sentences, and ordered rules over their identifiers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import ship_package

_FREE = "* is free software you can redistribute it and or modify it under the terms of"
_FSF = "as published by the free software foundation"
_LATER = "or at your option any later version"
_HOLDER = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
_CC = "this work is licensed under a creative commons attribution"

#: Sentences of public licence texts and notices, by identifier, in their normal form
#: (see ``normalise``). ``#`` stands for any number, the first is the licence's version; ``*`` for any
#: run of words, ``~`` at the end for nothing or one of ``TAILS``.
SENTENCES: dict[str, str] = {
    "mit_name": "the mit license ~",
    "mit_released": "released under the mit license ~",
    "mit_licensed": "licensed under the mit license ~",
    "mit_work": "this work is licensed under the mit license ~",
    "mit_grant": f"{_HOLDER} to deal in the software without restriction *",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability *",
    "as_is_software": "the software is provided as is without warranty of any kind express or implied *",
    "ncsa_grant": f"{_HOLDER} to deal with the software without restriction *",
    "ncsa_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",
    "apache_named": "licensed under the apache license version 2.0 ~",
    "apache_named_short": "licensed under the apache license version 2 ~",
    "apache_work": "this work is licensed under the apache license version 2.0 ~",
    "apache_released": "released under the apache license version 2.0 ~",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at *",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "apache_asf": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "apache_asf_licenses": "the asf licenses this file to you under the apache license version 2.0 ~",
    "apache_terms": "terms and conditions for use reproduction and distribution",
    "gpl_named": "this work is licensed under the gnu general public license version # ~",
    "gpl_licensed": "licensed under the gnu general public license version # ~",
    "gpl_released": "released under the gnu general public license version # ~",
    "gpl_short": "licensed under the gpl version # ~",
    "gplv_short": "licensed under the gplv# ~",
    "gpl_later": f"{_FREE} the gnu general public license {_FSF} either version # of the license {_LATER}",
    "gpl_only": f"{_FREE} the gnu general public license {_FSF} version # of the license",
    "gpl_version": f"{_FREE} the gnu general public license version # {_FSF}",
    "gpl_redistribute": f"{_FREE} the gnu general public license {_FSF} *",
    "hope": "* is distributed in the hope that it will be useful but without any warranty *",
    "gpl_details": "see the gnu general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with *",
    "lgpl_named": "this work is licensed under the gnu lesser general public license version # ~",
    "lgpl_licensed": "licensed under the gnu lesser general public license version # ~",
    "lgpl_short": "licensed under the lgplv# ~",
    "lgpl_later": f"{_FREE} the gnu lesser general public license {_FSF} either version # of the license {_LATER}",
    "lgpl_only": f"{_FREE} the gnu lesser general public license {_FSF} version # of the license",
    "lgpl_redistribute": f"{_FREE} the gnu lesser general public license {_FSF} *",
    "library_later": f"{_FREE} the gnu library general public license {_FSF} either version # of the license {_LATER}",
    "lgpl_details": "see the gnu lesser general public license for more details",
    "library_details": "see the gnu library general public license for more details",
    "lgpl_received": "you should have received a copy of the gnu lesser general public license along with *",
    "library_received": "you should have received a copy of the gnu library general public license along with *",
    "agpl_named": "this work is licensed under the gnu affero general public license version # ~",
    "agpl_licensed": "licensed under the gnu affero general public license version # ~",
    "agpl_short": "licensed under the agplv# ~",
    "agpl_later": f"{_FREE} the gnu affero general public license {_FSF} either version # of the license {_LATER}",
    "agpl_only": f"{_FREE} the gnu affero general public license {_FSF} version # of the license",
    "agpl_details": "see the gnu affero general public license for more details",
    "agpl_received": "you should have received a copy of the gnu affero general public license along with *",
    "perl_terms": "* is free software you can redistribute it and or modify it under the same terms as perl itself",
    "verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "cc_by": "licensed under cc by # ~",
    "cc_by_nc": "licensed under cc by nc # ~",
    "cc_by_sa": "licensed under cc by sa # ~",
    "cc_by_nd": "licensed under cc by nd # ~",
    "cc_by_nc_sa": "licensed under cc by nc sa # ~",
    "cc_by_nc_nd": "licensed under cc by nc nd # ~",
    "cc0": "licensed under cc0 # ~",
    "cc_by_this": "this work is licensed under cc by # ~",
    "cc_by_nc_this": "this work is licensed under cc by nc # ~",
    "cc_by_sa_this": "this work is licensed under cc by sa # ~",
    "cc_by_work": f"{_CC} # international license ~",
    "cc_by_nc_work": f"{_CC} noncommercial # international license ~",
    "cc_by_sa_work": f"{_CC} sharealike # international license ~",
    "cc_by_nd_work": f"{_CC} noderivatives # international license ~",
    "cc_by_nc_sa_work": f"{_CC} noncommercial sharealike # international license ~",
    "cc_by_nc_nd_work": f"{_CC} noncommercial noderivatives # international license ~",
    "cc_by_unported": f"{_CC} # unported license ~",
    "cc_by_sa_unported": f"{_CC} share alike # unported license ~",
    "cc_by_sa_unported_one": f"{_CC} sharealike # unported license ~",
    "cc0_waived": "to the extent possible under law * has waived all copyright and related or neighboring rights to *",
    "cc0_universal": "this work is marked with cc0 # universal ~",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice *",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice *",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement *",
    "bsd_names": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software *",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is *",
    "bsd_as_is_other": "this software is provided by * as is and any express or implied warranties *",
    "bsd_liable": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages *",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc_as_is": "the software is provided as is and * disclaims all warranties with regard to this software *",
    "hpnd_grant": "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that the above copyright notice appear in all copies *",
    "postgresql_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "mpl_named": "this source code form is subject to the terms of the mozilla public license v # ~",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at *",
    "mpl_contents": "the contents of this file are subject to the mozilla public license version # ~",
    "mpl_licensed": "licensed under the mozilla public license version # ~",
    "mpl_basis": "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied",
    "epl_v": "this program and the accompanying materials are made available under the terms of the eclipse public license v# *",
    "epl_v_spaced": "this program and the accompanying materials are made available under the terms of the eclipse public license v # *",
    "epl_available": "this program and the accompanying materials are made available under the terms of the eclipse public license # which *",
    "epl_licensed": "licensed under the eclipse public license version # ~",
    "cddl_contents": "the contents of this file are subject to the terms of the common development and distribution license *",
    "cddl_comply": "you may not use this file except in compliance with the license ~",
    "eupl_named": "licensed under the eupl version # *",
    "bsl_named": "distributed under the boost software license version # ~",
    "bsl_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software *",
    "bsl_notices": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software *",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software *",
    "unlicense_law": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib_notice": "this notice may not be removed or altered from any source distribution",
    "ofl_named": "this font software is licensed under the sil open font license version # ~",
    "artistic_named": "licensed under the artistic license # ~",
    "wtfpl_copies": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "beer_retain": "as long as you retain this notice you can do whatever you want with this stuff",
    "mspl_governs": "this license governs use of the accompanying software",
    "psf_agreement": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using *",
    "public_domain_file": "this file is in the public domain",
    "public_domain_placed": "* is hereby placed in the public domain",
    "public_domain_released": "released into the public domain",
    "spdx_tag": "spdx license identifier *",
    "reserved": "all rights reserved",
    "unauthorized": "unauthorized copying of this file via any medium is strictly prohibited",
    "confidential": "proprietary and confidential",
}

#: Licence and the names by which a line or a notice calls it, in their normal form. The first
#: number is the version.
NAMES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit license", "mit licence", "mit"]),
    ("Apache-2.0", ["apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache 2.0 license", "apache 2.0", "apache v2"]),
    ("LGPL", ["gnu lesser general public license version #", "gnu lesser general public license v#", "gnu lgpl v#", "gnu lgplv#", "lgpl v#", "lgplv#", "lgpl version #", "lgpl #"]),
    ("AGPL", ["gnu affero general public license version #", "gnu affero general public license v#", "gnu agpl v#", "gnu agplv#", "agpl v#", "agplv#", "agpl version #", "agpl #"]),
    ("GPL", ["gnu general public license version #", "gnu general public license v#", "gnu gpl v#", "gnu gplv#", "gnu gpl version #", "gpl v#", "gplv#", "gpl version #", "gpl #"]),
    ("BSD-3-Clause", ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "3 clause bsd", "new bsd license", "modified bsd license"]),
    ("BSD-2-Clause", ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "2 clause bsd", "simplified bsd license"]),
    ("MPL", ["mozilla public license version #", "mozilla public license v#", "mozilla public license #", "mpl #"]),
    ("EPL", ["eclipse public license version #", "eclipse public license v #", "eclipse public license v#", "eclipse public license #", "epl #"]),
    ("ISC", ["isc license", "isc"]),
    ("CC0-1.0", ["cc0 1.0", "cc0 1.0 universal"]),
    ("Unlicense", ["unlicense"]),
]
#: Names that say little without "license" before them or a verb of granting.
_BARE = {"mit", "isc", "apache 2.0", "apache v2", "unlicense"}
#: How a notice says it: subject words may stand before.
_GRANTED = ["licensed", "released", "distributed", "available", "published", "provided"]


def _named() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...], float]]]:
    """Sentences and rules for each name: granted by a verb, after "license", and alone on a line or with a head's rest."""
    known: dict[str, str] = {}
    rules = []
    for licence, names in NAMES:
        for name in names:
            plain = name.replace(" ", "_").replace("#", "n").replace(".", "_")
            own = {}
            for verb in _GRANTED:
                for article in ("the ", ""):
                    own[f"{verb}_{article.strip()}{plain}"] = f"{verb} under {article}{name} *"
                    own[f"is_{verb}_{article.strip()}{plain}"] = f"* is {verb} under {article}{name} *"
            own[f"line_{plain}"] = f"license {name} ~"
            if name not in _BARE:
                own[f"title_{plain}"] = f"{name} ~"
                own[f"the_{plain}"] = f"the {name} ~"
            if "version #" in name or name == "apache license version 2.0":
                own[f"head_{plain}"] = f"{name} *"
            for k, v in own.items():
                known[f"named_{k}"] = v
                rules.append((licence, (f"named_{k}",), 0.7 if k.startswith(("title_", "the_")) else 0.9))
    return known, rules


#: What a naming sentence may add to the name, mostly in brackets.
TAILS = [
    "the license",
    "the licence",
    "mit",
    "gpl",
    "gplv#",
    "lgplv#",
    "agplv#",
    "apache #",
    "cc by #",
    "cc by nc #",
    "cc by sa #",
    "cc by nd #",
    "cc by nc sa #",
    "cc by nc nd #",
    "mpl #",
    "or later",
    "or any later version",
    "or at your option any later version",
]

#: Licence, the sentence identifiers that prove it in this order, and how sure that is.
#: Licence ``*`` is the one that an identifier line names.
RULES: list[tuple[str, tuple[str, ...], float]] = [
    ("MIT", ("mit_grant", "mit_notice", "as_is_software", "mit_liable"), 1.0),
    ("GPL", ("named_head_gnu_general_public_license_version_n", "verbatim"), 1.0),
    ("LGPL", ("named_head_gnu_lesser_general_public_license_version_n", "verbatim"), 1.0),
    ("AGPL", ("named_head_gnu_affero_general_public_license_version_n", "verbatim"), 1.0),
    ("Apache-2.0", ("named_head_apache_license_version_2_0", "apache_terms"), 1.0),
    ("Apache-2.0", ("apache_asf", "apache_asf_licenses", "apache_comply", "apache_obtain", "apache_unless", "apache_see"), 1.0),
    ("Apache-2.0", ("apache_named", "apache_comply", "apache_obtain", "apache_unless", "apache_see"), 1.0),
    ("GPL", ("gpl_later", "hope", "gpl_details", "gpl_received"), 1.0),
    ("GPL", ("gpl_only", "hope", "gpl_details", "gpl_received"), 1.0),
    ("LGPL", ("lgpl_later", "hope", "lgpl_details", "lgpl_received"), 1.0),
    ("LGPL", ("library_later", "hope", "library_details", "library_received"), 1.0),
    ("AGPL", ("agpl_later", "hope", "agpl_details", "agpl_received"), 1.0),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names", "bsd_as_is", "bsd_liable"), 1.0),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is", "bsd_liable"), 1.0),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is_other", "bsd_liable"), 1.0),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liable"), 1.0),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is_other", "bsd_liable"), 1.0),
    ("CDDL", ("cddl_contents", "cddl_comply"), 1.0),
    ("MPL", ("mpl_contents", "apache_comply", "mpl_basis"), 1.0),
    ("MIT", ("mit_grant", "mit_notice", "as_is_software"), 1.0),
    ("NCSA", ("ncsa_grant", "ncsa_source", "bsd_binary", "bsd_names"), 1.0),
    ("Apache-2.0", ("apache_asf", "apache_asf_licenses", "apache_comply", "apache_obtain", "apache_unless"), 1.0),
    ("Apache-2.0", ("apache_named", "apache_comply", "apache_obtain", "apache_unless"), 1.0),
    ("GPL", ("gpl_later", "hope", "gpl_received"), 1.0),
    ("GPL", ("gpl_only", "hope", "gpl_received"), 1.0),
    ("GPL", ("gpl_version", "hope", "gpl_received"), 1.0),
    ("GPL", ("gpl_redistribute", "hope", "gpl_received"), 1.0),
    ("LGPL", ("lgpl_later", "hope", "lgpl_received"), 1.0),
    ("LGPL", ("lgpl_only", "hope", "lgpl_received"), 1.0),
    ("LGPL", ("lgpl_redistribute", "hope", "lgpl_received"), 1.0),
    ("LGPL", ("library_later", "hope", "library_received"), 1.0),
    ("AGPL", ("agpl_later", "hope", "agpl_received"), 1.0),
    ("AGPL", ("agpl_only", "hope", "agpl_received"), 1.0),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names"), 1.0),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is"), 1.0),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), 0.9),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is"), 1.0),
    ("ISC", ("isc_grant", "isc_as_is"), 1.0),
    ("ISC", ("isc_grant_old", "isc_as_is"), 1.0),
    ("0BSD", ("zero_grant", "isc_as_is"), 1.0),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"), 1.0),
    ("BSL", ("bsl_grant", "bsl_notices"), 1.0),
    ("Unlicense", ("unlicense_free", "unlicense_anyone", "unlicense_law"), 1.0),
    ("MPL", ("mpl_named", "mpl_copy"), 1.0),
    ("MPL", ("mpl_contents", "apache_comply"), 1.0),
    ("CDDL", ("cddl_contents", "apache_comply"), 1.0),
    ("MIT", ("mit_released",), 0.9),
    ("MIT", ("mit_licensed",), 0.9),
    ("MIT", ("mit_work",), 0.9),
    ("MIT", ("mit_name",), 0.8),
    ("MIT", ("mit_grant",), 0.8),
    ("Apache-2.0", ("apache_named",), 0.9),
    ("Apache-2.0", ("apache_named_short",), 0.9),
    ("Apache-2.0", ("apache_work",), 0.9),
    ("Apache-2.0", ("apache_released",), 0.9),
    ("Apache-2.0", ("apache_asf_licenses",), 0.9),
    ("GPL", ("gpl_named",), 0.9),
    ("GPL", ("gpl_licensed",), 0.9),
    ("GPL", ("gpl_released",), 0.9),
    ("GPL", ("gpl_short",), 0.9),
    ("GPL", ("gplv_short",), 0.9),
    ("GPL", ("gpl_later",), 0.8),
    ("GPL", ("gpl_only",), 0.8),
    ("GPL", ("gpl_version",), 0.8),
    ("GPL", ("gpl_redistribute",), 0.8),
    ("LGPL", ("lgpl_named",), 0.9),
    ("LGPL", ("lgpl_licensed",), 0.9),
    ("LGPL", ("lgpl_short",), 0.9),
    ("LGPL", ("lgpl_later",), 0.8),
    ("LGPL", ("lgpl_only",), 0.8),
    ("LGPL", ("lgpl_redistribute",), 0.8),
    ("LGPL", ("library_later",), 0.8),
    ("AGPL", ("agpl_named",), 0.9),
    ("AGPL", ("agpl_licensed",), 0.9),
    ("AGPL", ("agpl_short",), 0.9),
    ("AGPL", ("agpl_later",), 0.8),
    ("AGPL", ("agpl_only",), 0.8),
    ("Perl", ("perl_terms",), 0.9),
    ("CC-BY", ("cc_by",), 0.9),
    ("CC-BY", ("cc_by_this",), 0.9),
    ("CC-BY", ("cc_by_work",), 0.9),
    ("CC-BY", ("cc_by_unported",), 0.9),
    ("CC-BY-NC", ("cc_by_nc",), 0.9),
    ("CC-BY-NC", ("cc_by_nc_this",), 0.9),
    ("CC-BY-NC", ("cc_by_nc_work",), 0.9),
    ("CC-BY-SA", ("cc_by_sa",), 0.9),
    ("CC-BY-SA", ("cc_by_sa_this",), 0.9),
    ("CC-BY-SA", ("cc_by_sa_work",), 0.9),
    ("CC-BY-SA", ("cc_by_sa_unported",), 0.9),
    ("CC-BY-SA", ("cc_by_sa_unported_one",), 0.9),
    ("CC-BY-ND", ("cc_by_nd",), 0.9),
    ("CC-BY-ND", ("cc_by_nd_work",), 0.9),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",), 0.9),
    ("CC-BY-NC-SA", ("cc_by_nc_sa_work",), 0.9),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",), 0.9),
    ("CC-BY-NC-ND", ("cc_by_nc_nd_work",), 0.9),
    ("CC0-1.0", ("cc0",), 0.9),
    ("CC0-1.0", ("cc0_waived",), 0.9),
    ("CC0-1.0", ("cc0_universal",), 0.9),
    ("NCSA", ("ncsa_grant",), 0.8),
    ("BSD-2-Clause", ("bsd_grant",), 0.7),
    ("ISC", ("isc_grant",), 0.9),
    ("ISC", ("isc_grant_old",), 0.9),
    ("0BSD", ("zero_grant",), 0.8),
    ("HPND", ("hpnd_grant",), 0.9),
    ("PostgreSQL", ("postgresql_grant",), 0.9),
    ("MPL", ("mpl_named",), 0.9),
    ("MPL", ("mpl_contents",), 0.9),
    ("MPL", ("mpl_licensed",), 0.9),
    ("EPL", ("epl_v",), 0.9),
    ("EPL", ("epl_v_spaced",), 0.9),
    ("EPL", ("epl_available",), 0.9),
    ("EPL", ("epl_licensed",), 0.9),
    ("CDDL", ("cddl_contents",), 0.9),
    ("EUPL", ("eupl_named",), 0.9),
    ("BSL", ("bsl_named",), 0.9),
    ("BSL", ("bsl_grant",), 0.8),
    ("Unlicense", ("unlicense_free",), 0.9),
    ("Zlib", ("zlib_grant",), 0.8),
    ("OFL", ("ofl_named",), 0.9),
    ("Artistic", ("artistic_named",), 0.9),
    ("WTFPL", ("wtfpl_copies",), 0.9),
    ("Beerware", ("beer_retain",), 0.9),
    ("MS-PL", ("mspl_governs",), 0.8),
    ("Python", ("psf_agreement",), 0.9),
    ("public domain", ("public_domain_file",), 0.8),
    ("public domain", ("public_domain_placed",), 0.8),
    ("public domain", ("public_domain_released",), 0.8),
    ("*", ("spdx_tag",), 1.0),
    ("proprietary", ("unauthorized",), 0.8),
    ("proprietary", ("confidential",), 0.7),
    ("proprietary", ("reserved",), 0.5),
]


#: A span ends at a line's end, or at a stop before white space; a stop inside a number stays.
_ENDS = re.compile(r"[.!?;:]+(?=\s|$)|\n+")
_OTHER = re.compile(r"(?:(?!(?<=[0-9])\.[0-9])[^a-z0-9])+")
_NUMBER = r"\d+(?:\.\d+)*"
#: What an identifier line names, in the text as it is.
_TAG = re.compile(r"(?i:identifier):\s*([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)")
#: Parts of words one of which is in every known sentence; texts without hold none.
_CUES = (
    "licen", "permi", "warrant", "redistribut", "copyright", "rights", "condition", "spdx", "endorse", "software", "eupl",
    "domain", "gpl", "cc0", "bsd", "apache", "confidential", "notice", "prohibit", "liable",
)


def _cued(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in _CUES) or ("mpl" in low and "obtain one" in low)


#: Sentences and rules by name; the same words of the fixed list count before them, and what no part of a
#: word above gives away ("released under MIT") is left out.
_MORE_SENTENCES, _MORE_RULES = _named()
_MORE_SENTENCES = {k: v for k, v in _MORE_SENTENCES.items() if v not in set(SENTENCES.values()) and _cued(v)}
SENTENCES |= _MORE_SENTENCES
RULES += [r for r in _MORE_RULES if r[1][0] in _MORE_SENTENCES]


def normalise(sentence: str) -> str:
    """Lower case, everything else than letters, digits and points inside numbers as one space.
    Comment marks at a line's begin go with that."""
    return _OTHER.sub(" ", sentence.lower()).strip()


def sentences(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _ENDS.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


#: Characters that may stand between two parts of one sentence.
_GAP = 600


def _pattern(known: str) -> re.Pattern[str]:
    """A known sentence over a text's normal form, in which each line is a span of ``sentences``.

    Its words may run over any number of lines; it begins with a line and ends with one.
    A ``*`` at the end takes the rest of its line, at the begin what the line has before;
    one inside reaches on until the sentence begins anew, over a paragraph's length (``_GAP``
    characters) at most. The first number is group 1.
    """

    def words(part: str) -> str:
        return r"[ \n]".join(re.escape(w).replace(r"\#", f"(?:{_NUMBER})") for w in part.split())

    known, tail, _ = known.partition("~")
    first, *rest = known.split("*")
    out, anew = words(first), rf"(?!\n{words(first)}[ \n])" if first.strip() else r"(?!\n)"
    for part in rest:
        if not part.strip():
            out += r"(?: [^\n]*)?"
        else:
            out += rf"(?:{anew}[\s\S]){{0,{_GAP}}}?{'[ \n]' if out else '\\b'}{words(part)}"
    out = out.replace(f"(?:{_NUMBER})", f"({_NUMBER})", 1)
    if tail:
        out += rf"(?:[ \n](?:{'|'.join(map(words, TAILS))}))?"
    return re.compile(out + r"$", re.M)


def _plain_words(known: str) -> list[str]:
    """The words of a known sentence that stand as they are, up to the first that may vary."""
    out = []
    for w in known.lstrip("* ").split():
        if w in ("*", "~") or "#" in w:
            break
        out.append(w)
    return out


class _Book:
    def __init__(self, known: dict[str, str], rules: list[tuple[str, tuple[str, ...], float]]) -> None:
        #: By a sentence's first two words; by the first alone where the second may vary.
        self.starts: dict[tuple[str, str], list[tuple[bool, str, re.Pattern[str]]]] = {}
        self.inner: dict[tuple[str, str], list[tuple[bool, str, re.Pattern[str]]]] = {}
        for k, v in known.items():
            if v.strip():
                entry = ("*" in v.lstrip("*"), k, _pattern(v))
                first = v.split("*")[0].split()
                if first and first[0] != "~":
                    one, two = (*_plain_words(v), "", "")[:2]
                    self.starts.setdefault((one or first[0], two), []).append(entry)
                else:  # begins inside a line: known by its first two words
                    one, two = (*v.lstrip("* ").split(), "")[:2]
                    self.inner.setdefault((one, two), []).append(entry)
        # a text is looked into for an inner sentence only if it has the words that all of its group begin with
        common: dict[tuple[str, str], list[str]] = {}
        for v in known.values():
            if v.lstrip().startswith("*") and (words := _plain_words(v)):
                key = (words[0], (*words, "")[1])
                old = common.get(key, words)
                same = next((i for i, (a, b) in enumerate(zip(old, words, strict=False)) if a != b), min(len(old), len(words)))
                common[key] = old[:same]
        self.before = {k: re.compile(r"\b" + r"[ \n]".join(map(re.escape, w)) + r"\b") for k, w in common.items()}
        self.cued = all(map(_cued, known.values()))
        self.rules = rules

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of known sentences in order."""
        return [x[:3] for x in self.locate(text)]

    def locate(self, text: str) -> list[tuple[str, int, int, str | None]]:
        """(identifier, start, end, version) of known sentences in order; one that only ends another is part of it.

        Where several begin, the longest of those without ``*`` after their first word is taken, else the shortest.
        """
        out = []
        if not text or (self.cued and not _cued(text)):
            return out
        spans, lines = [], []
        for a, b in sentences(text):
            if plain := normalise(text[a:b]):
                spans.append((a, b))
                lines.append(plain)
        whole = "\n".join(lines)
        inner = [(k, self.inner[k]) for k in self.inner if k not in self.before or self.before[k].search(whole)]
        ends = [at - 1 for at in accumulate(len(x) + 1 for x in lines)]
        at, last = 0, -1
        for (a, _), plain in zip(spans, lines, strict=True):
            best = None
            one, two = (*whole[at : at + 60].split(None, 2), "", "")[:2]
            tried = [*self.starts.get((one, two), ()), *self.starts.get((one, ""), ())]
            for (one, two), entries in inner:
                if f"{one} {two}" in plain or plain.endswith(one):
                    tried += entries
            for loose, name, pattern in tried:
                m = pattern.match(whole, at)
                if m:
                    rank = (loose, m.end() if loose else -m.end())
                    if best is None or rank < best[0]:
                        best = rank, name, m
            if best and best[2].end() != last:
                _, name, m = best
                last = m.end()
                end = spans[bisect_left(ends, last)][1]
                version = m[1] if m.re.groups else None
                if name == "spdx_tag" and (tag := _TAG.search(text, a, text.find("\n", a) % (len(text) + 1))):
                    version, end = tag[1], max(end, tag.end())
                out.append((name, a, end, version))
            at += len(plain) + 1
        return out

    def match(self, found: list[tuple]) -> list[tuple[str, float, int, int, str | None]]:
        """(licence, score, start, end, version) of what ``find`` or ``locate`` gives: rules in their order, each sentence used once.

        A rule matches its identifiers in order, each as early as it can be; others may
        stand between. The version is the first number that its sentences name.
        """
        used = [False] * len(found)
        there = {name for name, *_ in found}
        out = []
        for licence, wanted, score in self.rules:
            if not there.issuperset(wanted):
                continue
            start = 0
            while True:
                picked, want = [], 0
                for i in range(start, len(found)):
                    if not used[i] and found[i][0] == wanted[want]:
                        picked.append(i)
                        want += 1
                        if want == len(wanted):
                            break
                if want < len(wanted):
                    break
                for i in picked:
                    used[i] = True
                version = next((v for i in picked for v in found[i][3:] if v), None)
                name, version = (version or "unknown", None) if licence == "*" else (licence, version)
                out.append((name, score, found[picked[0]][1], found[picked[-1]][2], version))
                start = picked[0] + 1
        if any(x[0] != "proprietary" for x in out):  # rights that are reserved beside a licence are the notice's
            out = [x for x in out if x[0] != "proprietary" or x[1] > 0.5]
        return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def licence_matches(col: Column, known: dict[str, str] | None = None, rules: list | None = None) -> Column:
    """Column of ``struct(sentences array<string>, matches array<struct(licence, score, start, end, version)>)``.

    Every sentence of the whole text is brought to its normal form and mapped to the
    identifier of a known one; the sequence of identifiers is matched against ordered
    rules, longest first; that all rights are reserved counts only where no licence is found. Positions are in code points, end exclusive; the version is the
    number that the sentences name, null if they name none. Null and empty texts have none.
    """
    book = _Book(known or SENTENCES, rules or RULES)
    fields = ("licence", "score", "start", "end", "version")
    schema = "sentences array<string>, matches array<struct<licence: string, score: double, start: long, end: long, version: string>>"

    @F.pandas_udf(schema)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found = book.locate(text or "")
                matches = [dict(zip(fields, m, strict=True)) for m in book.match(found)]
                rows.append(([name for name, *_ in found], matches))
            yield pd.DataFrame(rows, columns=["sentences", "matches"])

    return of(col)


def scan(docs: DataFrame, text_col: str = "text", out: str = "licence_scan", **options) -> DataFrame:
    """``docs`` with a column ``out`` of ``licence_matches``; rows are neither moved nor dropped.

    Repeated rows are scanned alike, an empty table gives no rows, and other columns pass,
    whatever their names; an existing column ``out`` is replaced.
    """
    ship_package(docs.sparkSession)
    return docs.withColumn(out, licence_matches(F.col(text_col), **options))
