"""Signature rules of the license scanner, written by hand: what each license is called, linked, tagged and quoted as.

A rule is priority (lower wins), confidence, label, keyword, pattern. Patterns are for lower-cased text; a space stands
for any white space, a space with a question mark for any or none. Each match of a pattern holds its keyword; where
there are several, parted by |, it holds one of them, and of those that & joins all.
"""

# Addresses.
LINKS = (
    (0, 0.98, "mit", "licenses/mit", r"opensource\.org/licenses/mit\b"),
    (0, 0.98, "apache", "apache.org/licenses", r"apache\.org/licenses/license-[12][\d.]*"),
    (1, 0.95, "apache", "apache.org/licenses", r"apache\.org/licenses/?(?!\w)"),
    (0, 0.98, "apache", "licenses/apache", r"opensource\.org/licenses/apache-?2[\d.]*"),
    (0, 0.98, "gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl(?:-\d[\d.]*)?"),
    (0, 0.98, "lgpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl(?:-\d[\d.]*)?"),
    (0, 0.98, "agpl", "gnu.org/licenses", r"gnu\.org/licenses/agpl(?:-\d[\d.]*)?"),
    (0, 0.98, "fdl", "gnu.org/licenses", r"gnu\.org/licenses/fdl(?:-\d[\d.]*)?"),
    (2, 0.8, "gpl", "gnu.org/licenses", r"gnu\.org/licenses/?(?![\w-])"),
    (0, 0.98, "gpl", "copyleft/gpl", r"gnu\.org/copyleft/gpl"),
    (0, 0.98, "lgpl", "copyleft/lesser", r"gnu\.org/copyleft/lesser"),
    (0, 0.98, "bsd-3-clause", "licenses/bsd-3", r"opensource\.org/licenses/bsd-3-clause"),
    (0, 0.98, "bsd-2-clause", "licenses/bsd-2", r"opensource\.org/licenses/bsd-2-clause"),
    (1, 0.95, "bsd", "licenses/bsd-license", r"opensource\.org/licenses/bsd-license"),
    (0, 0.98, "isc", "licenses/isc", r"opensource\.org/licenses/isc\b"),
    (0, 0.98, "mpl", "mozilla.org/mpl", r"mozilla\.org/(?:[a-z]{2}-[a-z]{2}/)?mpl(?:/\d[\d.]*)?"),
    (0, 0.98, "mpl", "licenses/mpl", r"opensource\.org/licenses/mpl-[12][\d.]*"),
    (0, 0.98, "epl", "eclipse.org/legal/epl", r"eclipse\.org/legal/epl[\w.-]*"),
    (0, 0.98, "bsl", "boost.org/license", r"boost\.org/license_1_0\.txt"),
    (0, 0.98, "unlicense", "unlicense.org", r"unlicense\.org"),
    (0, 0.98, "wtfpl", "wtfpl.net", r"wtfpl\.net"),
    (0, 0.98, "cc0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero(?:/1\.0)?"),
    (0, 0.98, "public-domain", "publicdomain/mark", r"creativecommons\.org/publicdomain/mark(?:/1\.0)?"),
    (0, 0.98, "cc-by-nc-nd", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd(?:/\d\.\d)?"),
    (0, 0.98, "cc-by-nc-sa", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa(?:/\d\.\d)?"),
    (0, 0.98, "cc-by-nc", "licenses/by-nc", r"creativecommons\.org/licenses/by-nc(?:/\d\.\d|(?![\w-]))"),
    (0, 0.98, "cc-by-nd", "licenses/by-nd", r"creativecommons\.org/licenses/by-nd(?:/\d\.\d)?"),
    (0, 0.98, "cc-by-sa", "licenses/by-sa", r"creativecommons\.org/licenses/by-sa(?:/\d\.\d)?"),
    (0, 0.98, "cc-by", "licenses/by", r"creativecommons\.org/licenses/by(?:/\d\.\d|(?![\w-]))"),
    (0, 0.98, "odbl", "opendatacommons.org", r"opendatacommons\.org/licenses/odbl[\w./-]*"),
    (0, 0.98, "odc-by", "opendatacommons.org", r"opendatacommons\.org/licenses/by\b"),
    (0, 0.98, "pddl", "opendatacommons.org", r"opendatacommons\.org/licenses/pddl\b"),
    (0, 0.98, "ofl", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    (0, 0.98, "ofl", "openfontlicense.org", r"openfontlicense\.org"),
    (0, 0.98, "eupl", "joinup.ec.europa.eu", r"joinup\.ec\.europa\.eu/[\w./-]*eupl[\w./-]*"),
    (0, 0.97, "artistic", "artistic-license", r"opensource\.org/licenses/artistic-license[\w.-]*"),
    (0, 0.97, "zlib", "licenses/zlib", r"opensource\.org/licenses/zlib\b"),
    (0, 0.97, "sspl", "mongodb.com/licensing", r"mongodb\.com/licensing/server-side-public-license"),
    (0, 0.97, "elastic", "elastic.co/licensing", r"elastic\.co/licensing/elastic-license"),
    (0, 0.97, "busl", "mariadb.com/bsl", r"mariadb\.com/bsl\d*"),
)

# Tags of package indexes.
CLASSIFIERS = (
    (0, 0.97, "mit", "mit license", r"license :: osi approved :: mit license"),
    (0, 0.97, "mit-0", "mit no attribution", r"license :: osi approved :: mit no attribution license"),
    (0, 0.97, "apache", "apache software license", r"license :: osi approved :: apache software license"),
    (0, 0.97, "bsd", "bsd license", r"license :: osi approved :: bsd license"),
    (0, 0.97, "isc", "isc license", r"license :: osi approved :: isc license"),
    (0, 0.97, "gpl", "(gpl", r"license :: osi approved :: gnu general public license(?: v\d(?: or later)?)? \(gpl\w*\+?\)"),
    (0, 0.97, "lgpl", "(lgpl", r"license :: osi approved :: gnu (?:lesser|library or lesser) general public license(?: v\d(?: or later)?)? \(lgpl\w*\+?\)"),
    (0, 0.97, "agpl", "affero", r"license :: osi approved :: gnu affero general public license v3(?: or later)?"),
    (0, 0.97, "mpl", "mozilla public license", r"license :: osi approved :: mozilla public license [12][\d.]* \(mpl [12][\d.]*\)"),
    (0, 0.97, "epl", "eclipse public license", r"license :: osi approved :: eclipse public license [12][\d.]*"),
    (0, 0.97, "psf", "python software foundation", r"license :: osi approved :: python software foundation license"),
    (0, 0.97, "zlib", "zlib/libpng", r"license :: osi approved :: zlib/libpng license"),
    (0, 0.97, "bsl", "boost software license", r"license :: osi approved :: boost software license 1\.0"),
    (0, 0.97, "artistic", "artistic license", r"license :: osi approved :: artistic license"),
    (0, 0.97, "unlicense", "the unlicense", r"license :: osi approved :: the unlicense"),
    (0, 0.97, "ofl", "sil open font", r"license :: osi approved :: sil open font license"),
    (0, 0.97, "eupl", "european union public", r"license :: osi approved :: european union public licence"),
    (0, 0.97, "cc0", "cc0", r"license :: cc0 1\.0 universal"),
    (0, 0.97, "public-domain", "public domain", r"license :: public domain"),
    (0, 0.97, "proprietary", "proprietary", r"license :: other/proprietary license"),
)

# Sentences that stand in license texts and notices.
PASSAGES = (
    (0, 0.98, "mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (1, 0.93, "mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies"),
    (1, 0.93, "mit", "deal in the software", r"to deal in the software without restriction, including without limitation the rights"),
    (0, 0.97, "x11", "x consortium", r"the name of the x consortium shall not be used in advertising"),
    (0, 0.98, "isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    (1, 0.9, "isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    (0, 0.97, "bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    (0, 0.97, "bsd-3-clause", "neither the name", r"neither the names? of .{1,80}? nor the names of (?:its|their|other) contributors may be used to endorse"),
    (0, 0.97, "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    (1, 0.9, "bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    (1, 0.9, "bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    (1, 0.9, "bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors \W?as is\W"),
    (0, 0.97, "bsl", "accompanying documentation", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    (0, 0.97, "zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    (1, 0.93, "zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    (0, 0.97, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (0, 0.97, "wtfpl", "you just do what", r"you just do what the f\w* you want to"),
    (0, 0.97, "apache", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    (1, 0.93, "apache", "without warranties or conditions", r"distributed on an \W?as is\W? basis, without warranties or conditions of any kind"),
    (1, 0.93, "apache", "notice file", r"licensed to the apache software foundation \(asf\) under one .{0,120}?notice file"),
    (0, 0.97, "apache", "grant of patent license", r"grant of patent license\. subject to the terms and conditions of this license"),
    (1, 0.95, "gpl", "free software foundation", r"as published by the free software foundation"),
    (0, 0.96, "gpl", "you can redistribute it", r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    (0, 0.96, "lgpl", "you can redistribute it", r"this library is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (1, 0.95, "gpl", "you should have received a copy", r"you should have received a copy of the gnu general public license"),
    (1, 0.95, "lgpl", "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    (1, 0.95, "agpl", "you should have received a copy", r"you should have received a copy of the gnu affero general public license"),
    (1, 0.9, "gpl", "fitness for a particular purpose", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    (0, 0.96, "agpl", "remote network interaction", r"remote network interaction; use with the gnu general public license"),
    (0, 0.96, "mpl", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    (0, 0.96, "mpl", "a copy of the mpl", r"if a copy of the mpl was not distributed with this file"),
    (0, 0.96, "epl", "this program and the accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (0, 0.96, "cddl", "the contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    (0, 0.96, "mpl", "the contents of this file", r"the contents of this file are subject to the mozilla public license"),
    (0, 0.96, "eupl", "you may not use this work except", r"you may not use this work except in compliance with the licence"),
    (0, 0.96, "fdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    (0, 0.96, "cc0", "waive", r"waive[sd]? all (?:copyright and related or neighboring rights|of (?:his or her|their|its) rights to the work)"),
    (0, 0.96, "ofl", "reserved font name", r"with reserved font names? "),
    (0, 0.96, "artistic", "standard version", r"\W?standard version\W? refers to (?:such a|the) package"),
    (0, 0.96, "psf", "psf is making", r"psf is making python available to licensee"),
    (0, 0.96, "openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    (0, 0.96, "postgresql", "postgresql", r"postgresql database management system .{0,40}?portions copyright"),
    (0, 0.96, "busl", "change date", r"change date: ?\S+ .{0,60}?change license"),
    (0, 0.96, "sspl", "the functionality of the program", r"if you make the functionality of the program .{0,60}?available to third parties as a service|making the functionality of the program .{0,60}?available to third parties as a service"),
    (0, 0.96, "beerware", "beer-ware", r"\W?the beer-ware license\W?"),
    (0, 0.96, "json", "be used for good", r"the software shall be used for good, not evil"),
    (1, 0.9, "public-domain", "public domain", r"(?:released|dedicated|placed)(?: in)?to the public domain"),
    (1, 0.9, "public-domain", "public domain", r"(?:this (?:work|text|file|software|code|image) is |is hereby |are )in the public domain"),
    (1, 0.9, "proprietary", "all rights reserved", r"(?:proprietary and confidential\W+)?all rights reserved"),
    (1, 0.9, "proprietary", "proprietary", r"(?:this (?:software|file|document|material) (?:is|contains) )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    (1, 0.9, "proprietary", "prior written", r"may not be (?:reproduced|copied|distributed|used)[\w, ]{0,60}? without the (?:express )?prior written (?:permission|consent)"),
    (1, 0.9, "proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|work)[\w, ]{0,40}? is strictly prohibited"),
    (1, 0.88, "cc-by", "some rights reserved", r"some rights reserved"),
    (2, 0.9, "spdx", "spdx-license-identifier", r"spdx-license-identifier: ?[\w.+-]+(?: (?:or|and|with) [\w.+-]+)*"),
)

# Short names that stand for a license by themselves, mostly with a version.
SHORT = (
    (3, 0.85, "agpl", "agpl", r"\b(?:gnu )?agpl[ -]?(?:v|version )?\d(?:\.\d)*(?:\+|-only|-or-later)?"),
    (3, 0.85, "lgpl", "lgpl", r"\b(?:gnu )?lgpl[ -]?(?:v|version )?\d(?:\.\d)*(?:\+|-only|-or-later)?"),
    (3, 0.85, "gpl", "gpl", r"\b(?:gnu )?gpl[ -]?(?:v|version )?\d(?:\.\d)*(?:\+|-only|-or-later)?"),
    (4, 0.8, "agpl", "gnu agpl", r"\bgnu agpl\b"),
    (4, 0.8, "lgpl", "gnu lgpl", r"\bgnu lgpl\b"),
    (4, 0.8, "gpl", "gnu gpl", r"\bgnu gpl\b"),
    (4, 0.8, "fdl", "gfdl", r"\bgfdl\b"),
    (4, 0.8, "fdl", "gnu fdl", r"\bgnu fdl\b"),
    (3, 0.85, "apache", "apache", r"\bapache[ -]?(?:v|version )?2(?:\.0)?\b(?!\.\d)"),
    (4, 0.8, "apache", "asl2|asl 2", r"\basl ?2\.0\b"),
    (3, 0.85, "bsd-4-clause", "bsd", r"\bbsd[ -]4[ -]clause(?: licen[cs]e)?\b"),
    (3, 0.85, "bsd-3-clause", "bsd", r"\bbsd[ -]3(?:[ -]clause)?(?: licen[cs]e)?\b"),
    (3, 0.85, "bsd-2-clause", "bsd", r"\bbsd[ -]2(?:[ -]clause)?(?: licen[cs]e)?\b"),
    (3, 0.85, "bsd-3-clause", "clause bsd", r"\b(?:3|three)[ -]clause bsd(?: licen[cs]e)?\b"),
    (3, 0.85, "bsd-2-clause", "clause bsd", r"\b(?:2|two)[ -]clause bsd(?: licen[cs]e)?\b"),
    (3, 0.85, "0bsd", "0bsd", r"\b0bsd\b"),
    (4, 0.8, "bsd", "bsd-licensed|bsd licensed", r"\bbsd[- ]licensed\b"),
    (4, 0.8, "mit", "mit-licensed|mit licensed", r"\bmit[- ]licensed\b"),
    (4, 0.8, "apache", "apache-licensed|apache licensed", r"\bapache[- ]licensed\b"),
    (4, 0.8, "gpl", "gpl", r"\bgpl(?:'d|ed|[- ]licensed|[- ]compatible)\b"),
    (3, 0.85, "mit-0", "mit-0", r"\bmit-0\b"),
    (4, 0.8, "mit", "expat", r"\bexpat licen[cs]e\b"),
    (4, 0.8, "x11", "mit/x11", r"\bmit/x11\b"),
    (3, 0.85, "mpl", "mpl", r"\bmpl[ -]?(?:v|version )?[12](?:\.\d)?\b"),
    (3, 0.85, "epl", "epl", r"\bepl[ -]?(?:v|version )?[12](?:\.\d)?\b"),
    (3, 0.85, "cddl", "cddl", r"\bcddl[ -]?(?:v|version )?1(?:\.\d)?\b"),
    (3, 0.85, "eupl", "eupl", r"\beupl[ -]?(?:v|version )?1(?:\.\d)?\b"),
    (3, 0.85, "osl", "osl3|osl 3|osl-3", r"\bosl[ -]?3(?:\.\d)?\b"),
    (3, 0.85, "afl", "afl3|afl 3|afl-3", r"\bafl[ -]?3\.\d\b"),
    (3, 0.85, "bsl", "bsl", r"\bbsl-1\.0\b"),
    (3, 0.85, "busl", "busl", r"\bbusl-1\.1\b"),
    (3, 0.85, "sspl", "sspl", r"\bsspl(?:[ -]?v?1(?:\.0)?)?\b"),
    (3, 0.85, "upl", "upl", r"\bupl-1\.0\b"),
    (3, 0.85, "ofl", "ofl", r"\b(?:sil )?ofl[ -]?(?:v|version )?1\.[01]\b"),
    (3, 0.85, "odbl", "odbl", r"\bodbl(?:[ -]?1\.0)?\b"),
    (3, 0.85, "wtfpl", "wtfpl", r"\bwtfpl\b"),
    (3, 0.85, "ms-pl", "ms-pl", r"\bms-pl\b"),
    (3, 0.85, "ms-rl", "ms-rl", r"\bms-rl\b"),
    (3, 0.85, "artistic", "artistic", r"\bartistic[ -][12]\.0\b"),
    (3, 0.85, "zlib", "zlib-ack|zlib/libpng", r"\bzlib-acknowledgement\b|\bzlib/libpng\b"),
    (3, 0.85, "postgresql", "postgresql", r"\bpostgresql licence\b"),
    (3, 0.85, "cecill", "cecill", r"\bcecill(?:-[bc])?[ -]?\d(?:\.\d)?\b"),
    (3, 0.85, "lppl", "lppl", r"\blppl(?:[ -]?1\.\d\w?)?\b"),
    (3, 0.85, "mulan", "mulan", r"\bmulanpsl-\d(?:\.\d)?\b"),
    (3, 0.85, "blueoak", "blueoak", r"\bblueoak-1\.0\.0\b"),
    (3, 0.85, "ncsa", "ncsa", r"\buoi-ncsa\b"),
    (3, 0.85, "cc0", "cc0", r"\bcc0[ -]1\.0(?:[ -]universal)?\b"),
    (3, 0.85, "cc-by-nc-nd", "nc-nd", r"\bcc[ -]by[ -]nc-nd(?:[ -]\d\.\d)?\b"),
    (3, 0.85, "cc-by-nc-sa", "nc-sa", r"\bcc[ -]by[ -]nc-sa(?:[ -]\d\.\d)?\b"),
    (3, 0.85, "cc-by-nc", "by-nc", r"\bcc[ -]by-nc(?:[ -]\d\.\d)\b"),
    (3, 0.85, "cc-by-nd", "by-nd", r"\bcc[ -]by-nd(?:[ -]\d\.\d)\b"),
    (3, 0.85, "cc-by-sa", "by-sa", r"\bcc[ -]by-sa(?:[ -]\d\.\d)\b"),
    (3, 0.85, "cc-by", "cc by|cc-by", r"\bcc[ -]by[ -]\d\.\d\b"),
    (3, 0.85, "cc-by", "creative commons", r"creative commons attribution(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    (3, 0.85, "cc-by-sa", "creative commons", r"creative commons attribution-share ?alike(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    (3, 0.85, "cc-by-nc", "creative commons", r"creative commons attribution-non-?commercial(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    (3, 0.85, "cc-by-nc-sa", "creative commons", r"creative commons attribution-non-?commercial-share ?alike(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    (3, 0.85, "cc-by-nc-nd", "creative commons", r"creative commons attribution-non-?commercial-no ?deriv(?:ative)?s?(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    (3, 0.85, "cc-by-nd", "creative commons", r"creative commons attribution-no ?deriv(?:ative)?s?(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    (3, 0.85, "cc0", "creative commons", r"creative commons (?:cc0|zero)(?: \d\.\d)?(?: universal)?(?: public domain dedication)?"),
    (4, 0.75, "gpl", "copyleft", r"\bcopyleft (?:software|license)\b"),
)

# What stands after "license:" and the like in headers, manifests and front matter.
FIELD = r"\blicen[cs]es?[\"']? ?[:=]{1,2} ?[\"'\[({<]* ?(?:the )?"
FIELDS = tuple(
    (2, 0.92, label, f"licen&{word}", FIELD + name)
    for label, word, name in (
        ("mit", "mit", r"mit\b(?!-0)"),
        ("mit-0", "mit-0", r"mit-0\b"),
        ("apache", "apache", r"apache(?:[ -]?(?:software |licen[cs]e,? )?(?:v|version )?[12](?:\.\d)?)?\b"),
        ("apache", "asl", r"asl[ -]?2(?:\.0)?\b"),
        ("gpl", "gpl", r"(?:gnu )?gpl(?:[ -]?v?\d(?:\.\d)?(?:\+|-only|-or-later)?)?(?!\w)"),
        ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:[ -]?v?\d(?:\.\d)?(?:\+|-only|-or-later)?)?(?!\w)"),
        ("agpl", "agpl", r"(?:gnu )?agpl(?:[ -]?v?\d(?:\.\d)?(?:\+|-only|-or-later)?)?(?!\w)"),
        ("bsd-2-clause", "bsd", r"(?:bsd[ -]2(?:[ -]clause)?|(?:2|two)[ -]clause bsd)\b"),
        ("bsd-3-clause", "bsd", r"(?:bsd[ -]3(?:[ -]clause)?|(?:3|three)[ -]clause bsd|new bsd)\b"),
        ("bsd-4-clause", "bsd", r"bsd[ -]4(?:[ -]clause)?\b"),
        ("bsd", "bsd", r"bsd\b(?![ -]\d)"),
        ("0bsd", "0bsd", r"0bsd\b"),
        ("isc", "isc", r"isc\b"),
        ("mpl", "mpl", r"mpl(?:[ -]?[12](?:\.\d)?)?\b"),
        ("epl", "epl", r"epl(?:[ -]?[12](?:\.\d)?)?\b"),
        ("cddl", "cddl", r"cddl(?:[ -]?1(?:\.\d)?)?\b"),
        ("eupl", "eupl", r"eupl(?:[ -]?1(?:\.\d)?)?\b"),
        ("bsl", "bsl", r"bsl(?:-1\.0)?\b"),
        ("busl", "busl", r"busl(?:-1\.1)?\b"),
        ("zlib", "zlib", r"zlib\b"),
        ("unlicense", "unlicense", r"(?:the )?unlicense\b"),
        ("wtfpl", "wtfpl", r"wtfpl\b"),
        ("cc0", "cc0", r"cc0(?:[ -]1\.0)?\b"),
        ("cc-by-nc-nd", "nc-nd", r"cc[ -]by-nc-nd(?:[ -]\d\.\d)?\b"),
        ("cc-by-nc-sa", "nc-sa", r"cc[ -]by-nc-sa(?:[ -]\d\.\d)?\b"),
        ("cc-by-nc", "by-nc", r"cc[ -]by-nc(?:[ -]\d\.\d)?\b(?!-)"),
        ("cc-by-nd", "by-nd", r"cc[ -]by-nd(?:[ -]\d\.\d)?\b"),
        ("cc-by-sa", "by-sa", r"cc[ -]by-sa(?:[ -]\d\.\d)?\b"),
        ("cc-by", "cc", r"cc[ -]by(?:[ -]\d\.\d)?\b(?!-)"),
        ("odbl", "odbl", r"odbl(?:[ -]1\.0)?\b"),
        ("ofl", "ofl", r"ofl(?:[ -]1\.[01])?\b"),
        ("fdl", "gfdl", r"gfdl(?:[ -]1\.\d)?\b"),
        ("artistic", "artistic", r"artistic(?:[ -][12]\.0)?\b"),
        ("psf", "psf", r"psf(?:-2\.0)?\b"),
        ("php", "php", r"php(?:-3\.\d+)?\b"),
        ("ruby", "ruby", r"ruby\b"),
        ("postgresql", "postgresql", r"postgresql\b"),
        ("openssl", "openssl", r"openssl\b"),
        ("curl", "curl", r"curl\b"),
        ("ncsa", "ncsa", r"(?:uoi-)?ncsa\b"),
        ("ms-pl", "ms-pl", r"ms-pl\b"),
        ("sspl", "sspl", r"sspl(?:-1\.0)?\b"),
        ("elastic", "elastic", r"elastic(?:-2\.0)?\b"),
        ("lppl", "lppl", r"lppl(?:-1\.\d\w?)?\b"),
        ("openrail", "openrail", r"(?:creativeml-|bigscience-)?openrail(?:\+\+|-m)?"),
        ("proprietary", "proprietary", r"proprietary\b"),
        ("proprietary", "unlicensed", r"unlicensed\b"),
        ("public-domain", "public", r"public[ -]domain\b"),
    )
)

SIGNATURES = (*LINKS, *CLASSIFIERS, *PASSAGES, *SHORT, *FIELDS)
