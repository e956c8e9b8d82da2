"""Small inputs whose results are known: a graph of 222 vertices, and two tables of baskets."""

#: Smaller vertex: larger ones that it is joined to.
GRAPH = (
    "0:1;1:5,10,12,15,20,22,30,31,34,41,42,44,48,52,60,69,72,81,82,83,86,98,110,115,117,127,128,141,142,148,149,151,152,153,155,158,159,165,177,178,193,200"
    ",203,204,205,208,209,214,216,219,220,221;2:161;3:80,86,187,207;4:40,156;5:15,152;6:52,67,68,73;7:148;8:166;9:26,129,144;10:152;11:73;12:83,86,142,152,"
    "219,221;13:91;14:163;15:28,42,50,52,73,81,98,99,105,120,141,142,148,150,152,158,161,196,203,206,221;16:181;17:171;18:132;19:40,156;20:152;21:67,68,70,"
    "133,199;22:52,86,152,159,219,221;23:36,73,91,146,197;24:73,161;25:144,147,170;26:129,144;27:167;29:73,77,146;30:39,142,149,152,158,221;32:73;33:192;34"
    ":60;35:103;36:77,139;37:46,54,57,62,84,94,104,123,137,145,173,186,201,211;38:119,120;40:43,64,104,108,138,156,184,189,201;41:78;43:64,104,156,184,201;"
    "45:129,144;46:54,57,62,84,94,104,123,137,145,173,186,201,211;47:210;48:152;49:51,76,136,191;52:73,125,142,149,152,158,175,208;53:154,163,212;54:57,62,"
    "84,94,104,123,137,145,173,186,201,211;55:167;56:152;57:62,84,94,104,123,137,145,173,186,201,211;58:148;59:176;60:78,110;61:75;62:84,94,104,123,137,145"
    ",173,186,201,211;63:190;64:104,131,156,184,201;65:144;66:144;67:68,85,135,162,168,189,199,215;68:85,135,162,189,199,215;70:133,199;71:73,130,134,212;7"
    "3:74,81,91,93,95,98,114,118,134,139,146,161,163,167,174,182,192,196,212;79:189;80:86,207;81:96,107,141,142,152,176,188,195,219,221;83:142,149,152;84:9"
    "4,104,123,137,145,173,186,201,211;85:135;86:142,207,219,221;87:156;88:176;89:103;90:163,212;91:112,121,134,148,163,167,182,188,212;92:167;93:146;94:10"
    "4,123,137,145,173,186,201,211;97:156;100:212;101:140;102:104,201;104:123,131,137,145,156,173,184,186,198,201,211;105:152;106:184,194,201;107:142;108:1"
    "38,156,189;109:156,201;111:157;113:152;116:149;119:120;121:163;122:163;123:137,145,173,186,201,211;124:163;125:142,149,152;126:174;127:142;129:144;131"
    ":156,201;133:199;137:145,173,186,201,211;138:156,189;140:190;141:142,148,149,152,219;142:148,149,150,151,152,155,158,159,180,203,204,208,219,221;143:2"
    "13;144:147,164,170,198;145:173,186,201,211;147:170;148:149,152,158,188,219,221;149:152,158,159,177,204,208,219,221;150:152;151:152;152:158,159,177,203"
    ",204,208,209,219,221;154:163;155:221;156:184,189,198,201;158:159,204,219,221;159:221;160:210;163:169,192,212;165:221;172:179;173:186,201,211;176:188;1"
    "83:188;184:194,201;185:201;186:201,211;188:202;192:212;194:201;198:201;199:215;201:211;209:221;210:217;212:218;219:221"
)

#: The vertices of the communities that cutting the graph at its busiest edges gives.
COMMUNITIES = (
    "8,166;16,181;17,171;18,132;61,75;111,157;143,213;172,179;35,89,103;38,119,120;47,160,210,217;63,101,140,190;49,51,76,136,191;59,88,176,183,188,202;9,2"
    "5,26,45,65,66,129,144,147,164,170;6,21,67,68,70,79,85,133,135,162,168,189,199,215;4,19,37,40,43,46,54,57,62,64,84,87,94,97,102,104,106,108,109,123,131"
    ",137,138,145,156,173,184,185,186,194,198,201,211;2,11,13,14,23,24,27,29,32,33,36,53,55,71,73,74,77,90,91,92,93,95,100,112,114,118,121,122,124,126,130,"
    "134,139,146,154,161,163,167,169,174,182,192,196,197,212,218;0,1,3,5,7,10,12,15,20,22,28,30,31,34,39,41,42,44,48,50,52,56,58,60,69,72,78,80,81,82,83,86"
    ",96,98,99,105,107,110,113,115,116,117,125,127,128,141,142,148,149,150,151,152,153,155,158,159,165,175,177,178,180,187,193,195,200,203,204,205,206,207,"
    "208,209,214,216,219,220,221"
)

#: Edges of the largest betweenness.
BUSIEST = [(156, 189, 4234.0), (6, 52, 3986.487302), (6, 67, 3857.0), (6, 68, 3724.0), (6, 73, 3669.512698), (67, 189, 3335.0), (68, 189, 3289.0), (1, 52, 2216.617471)]

#: Key: items.
BASKETS_1 = (
    "1:98,100,101,102;2:97,99,100,101;3:97,98,99,102,103,105;4:97,99,101,102,103;5:97,98;6:101,102;7:97,99,101;8:97,98,99,102,103,104;9:97,98,99;10:97,98;1"
    "1:97,98,99;12:98,100,101,102,105,106,107,108;13:98,99,100,101,102,103,105,106,107,108;14:97;15:97,99,101;16:98,99,100,101;17:97,99;18:97,98,99;19:97,9"
    "8,102"
)

BASKETS_2 = (
    "1:97,100,103,105,106,107;2:97;3:97,99,100,101,102,103,106,107,111,112,115,116;4:97,100,101,103,104,106,107,108;5:97,98,99,100,101;6:97,99,100,101,103,"
    "106,107;7:98,99,100,102,104;8:97,98;9:97,99,101,102,103,104,105,106,108,110,111,113;10:98,101,102,103,105,107,108,109,110,111,112,113,114,115;11:97,98"
    ",99,101,103,104,105,108,109,110,112,113;12:97,98,100,101,102,103,104;13:97,98,99,100;14:98,99,102,103,104,105,106,108,110,111,113,114;15:97,99,101,102"
    ",104,105,107,108,109,111;16:99,102,103,104,105,106,107,108,109,110,112,114,116;17:97,98,99,101,102,103,104,105,106;18:97,100,101,103,105,106,107,108,1"
    "10,111,114,115;19:102,103,104,105,106,107,108,109,110,111;20:97,98,99;21:97,100,101,103;22:97,98,99,100,104,106;23:100,102,104,106,107,109,110,111,113"
    ",114,116,117,118;24:97,98,100,105,108,110,111,113,115,116,117,118,120,121;25:97,98,99,100,103,106,107,111,112,113,114,115,116;26:97,98,99,100,101,102,"
    "103,105,108,110,112,115,116;27:97,99,102,103,105,107,108,109,110,111;28:99,103,105,106,107,109,110,112,113,114,115,116,117;29:98;30:97,99,100,101,102,"
    "104;31:97,99,100,103,104,105;32:97,98,99,100,101,103,104;33:98,99,100,102,103,104,106,107,108,109,110,112,113,114,116,117;34:97,98,100,101,102,105,106"
    ",107,108,109,112,113,114,115;35:97,99,101,102,104,105,108,109,110;36:98,99,100,101;37:97;38:99,100,102,103,104,107,108,109,110,112,114,115,116,119;39:"
    "97,98,99,100,102,104,106,108,110,113,116,118,119,120,121;40:101,102,104,105,106,108,110,111,112,113,114,117,118,119,120;41:97,99,100,101,102,103,105,1"
    "08,109,112,114;42:99,100,101,102,103,104,106,107,111,112,113,114,118,120;43:97,98,99,101,102,103,105,106,107,109,111;44:97,98,99,102,103,106,107,108,1"
    "09,112,113,114,115;45:97,99,100,101,102,105;46:99,100,101,102,103,104,107,108,110,113,114,116,117,118,119;47:98,99,100,103;48:97,99,100,101,102,104,10"
    "5,107;49:97,99,100,101,102,104,105,106,108"
)
